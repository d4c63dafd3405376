import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those used inside the operators.
CLASHING = ("key", "rep", "band", "block", "hash", "id", "at", "words", "root", "_row", "_strong", "n_words", "labels", "kept", "bucket", "_bad", "_first")


def with_clashes(frame):
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def sentences():
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 8))) for _ in range(400)] + "the of and to in".split() * 8

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows(sentences):
    """Nulls, empty and blank texts, copies, near copies, shared passages, repeated rows and a very long text."""
    base, passage = sentences(120, 1), sentences(60, 2)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"), (None, base, "en"), (None, None, None),
        (7, "one two", "en"), (8, "one two", "en"), (9, f"{sentences(80, 3)}\n{passage} {sentences(30, 4)}", "en"), (10, f"{sentences(20, 5)} {passage}\n{sentences(90, 6)}", "en"),
        (11, sentences(30000, 7), "en"), (12, "é ü 漢字   x\x00y " * 20, "fr"), (3, " ".join(near), "en"), (13, f"{passage} {passage}", "en"), (14, "a " * 300, "en"),
    ]
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]


@pytest.fixture()
def edge_docs(spark, edge_rows):
    return with_clashes(spark.createDataFrame(edge_rows, SCHEMA))


@pytest.fixture()
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
