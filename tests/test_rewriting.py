"""Many edits of a text against plain code."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linewright.functions import rewriting
from linewright.operators import extract, translate

BORDERS = set("|│｜┃")
WORDS = extract.Config(base="([a-z]{3,})", invalid="^and$", symbol="[#]", brackets=False)


def plain(text, edits):
    out = text.split("\n")
    for i, line in enumerate(out, 1):
        mine = [e for e in edits if e[0] == i or not 1 <= e[0] <= len(out)]
        for _, _, a, b in sorted(mine, key=lambda e: (-len(e[2]), *e[1:])):
            parts = line.split(a)
            line = parts[0]
            for k, part in enumerate(parts[1:], 1):
                line += b + ("　" * (len(a) - len(b)) if set(a.join(parts[k:])) & BORDERS else "") + part
        out[i - 1] = line
    return "\n".join(out)


@pytest.mark.parametrize(("long", "piece"), [(1 << 20, 256), (0, 256), (0, 2), (0, 0)])
def test_edits_in_turn(monkeypatch, long, piece):
    monkeypatch.setattr(rewriting, "LONG", long)
    monkeypatch.setattr(rewriting, "PIECE", piece)
    random.seed(7)
    some = lambda chars, low, high: "".join(random.choice(chars) for _ in range(random.randint(low, high)))
    for i in range(3000):
        chars = "abc" if i % 2 else "ab|"
        text = some("abc .|\n", 0, 30)
        edits = [(random.randint(0, 3), pos, some(chars, 1, 3), some("abcx" if i % 3 else "ab|", 0, 3)) for pos in range(random.randint(1, 6))]
        assert rewriting.rewritten(text, edits) == plain(text, edits), (text, edits)


def test_long_line(spark):
    """A line of many fragments takes time in proportion to its length, about."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, original string")
    found = found.select(F.lit(1).alias("doc_id"), F.lit("001-1").alias("frag_id"), "pos", "original", F.upper("original").alias("translation"))
    began = time.time()
    assert translate.apply(docs, found).first()["text"] == " ".join(words).upper()
    assert time.time() - began < 25


def test_all_at_once(spark):
    """As a join of fragments with their translations, also for texts that share an id, or have none."""
    rows = [(1, "cat |and dog\n\nbird dogcat"), (2, None), (3, "owl cat owl |"), (3, "hen\nowl"), (4, ""), (None, "cat"), (5, "no # one\ncat")]
    docs = spark.createDataFrame([(*row, str(i)) for i, row in enumerate(rows)], "doc_id long, text string, other string")
    made = lambda x: (F.when(x["seq"] == 0, 0).otherwise(x["line_no"]), F.left(x["text"], F.lit(2)))
    got = {r["other"]: r["text"] for r in translate.apply_all(docs, made, WORDS).collect()}
    found = extract.numbered(docs, WORDS)
    line_no, short = made({name: F.col(name) for name in found.columns})
    fresh = found.select("doc_id", F.concat_ws("-", line_no, "seq").alias("frag_id"), F.col("seq").alias("pos"), F.col("text").alias("original"), short.alias("translation"))
    assert got == {r["other"]: r["text"] for r in translate.apply(docs, fresh).collect()}
    assert got["0"] == "ca　 |and do\n\nbi do" and got["1"] is None and got["5"] == "cat" and len(got) == len(rows)


def test_no_translation(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "001-1", 0, "a", None), (1, "001-2", 1, "b", "c")], "doc_id long, frag_id string, pos int, original string, translation string")
    assert translate.apply(docs, found).first()["text"] == "a c"
