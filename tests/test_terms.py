"""Glossaries as tables against the expressions for small ones, plain patterns, and one of 100,000 terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linewright.operators import glossary, terms


def plain(text, pairs):
    if text is None:
        return None
    pattern = re.compile("|".join(re.escape(k) for k in sorted(pairs, key=len, reverse=True)))

    def line(one):
        pad = lambda m: "　" * (len(m[0]) - len(pairs[m[0]])) if re.search("[|│｜┃]", one[m.end() :]) else ""
        return pattern.sub(lambda m: pairs[m[0]] + pad(m), one)

    return "\n".join(map(line, text.split("\n")))


def drawn(seed):
    r = random.Random(seed)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(1, n)))
    pairs = {word("abc😀|", 4): word("xy", 3) if r.random() < 0.9 else "" for _ in range(14)}
    texts = ["".join(r.choice("abc😀 |\n│　") for _ in range(r.randrange(60))) for _ in range(60)] + [None, ""]
    return pairs, texts


@pytest.mark.parametrize(("seed", "most"), [(1, terms.SHARD_BYTES), (2, 60), (3, 150)])
def test_equals_small_glossaries(spark, seed, most):
    """The same result by one shard, by a shard for almost every term, and by the expression."""
    pairs, texts = drawn(seed)
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int").withColumns({"_found": F.lit(1), "a b": F.lit(2)})
    table = spark.createDataFrame([*pairs.items(), ("", "x"), (None, "x"), ("a\nb", "x")], "key string, value string")
    got = terms.apply(docs, table, most=most)
    assert got.columns == docs.columns
    done = [r["text"] for r in got.orderBy("i").collect()]
    assert done == [plain(t, pairs) for t in texts]
    assert done == [r["t"] for r in docs.select("i", glossary.apply(F.col("text"), pairs).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("most", [terms.SHARD_BYTES, 80])
def test_reverse_equals_small_glossaries(spark, most):
    originals = {"xy": "abcd", "x": "b", "yyx": "a", "漢": "長い言葉"}
    r = random.Random(4)
    texts = ["".join(r.choice("xy漢　 \n|") for _ in range(r.randrange(50))) for _ in range(80)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame(list(originals.items()), "value string, key string")
    got = [x["text"] for x in terms.reverse(docs, table, most=most).orderBy("i").collect()]
    assert got == [x["t"] for x in docs.select("i", glossary.reverse(F.col("text"), originals).alias("t")).orderBy("i").collect()]


def test_applied_and_reversed(spark):
    docs = spark.createDataFrame([("猫と犬 |",), ("猫\n犬",)], "text string")
    table = spark.createDataFrame([("猫", "cat"), ("犬", "d")], "key string, value string")
    there = terms.apply(docs, table)
    assert {r["text"] for r in there.collect()} == {"catとd |", "cat\nd"}
    back = terms.reverse(there, glossary.reverse_map(table.withColumn("pos", F.lit(0))))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in docs.collect())


def test_no_terms(spark):
    docs = spark.createDataFrame([("a",), (None,)], "text string")
    none = spark.createDataFrame([], "key string, value string")
    assert [r["text"] for r in terms.apply(docs, none).collect()] == ["a", None]
    assert terms.apply(docs.limit(0), none).count() == 0


def test_hundred_thousand_terms(spark):
    table = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")).alias("value"))
    docs = spark.range(2000).select("id", F.concat(F.lit("a term"), F.col("id").cast("string"), F.lit("x term"), (99_999 - F.col("id")).cast("string"), F.lit("77")).alias("text"))
    got = terms.apply(docs, table).orderBy("id").collect()
    assert [r["text"] for r in got] == [f"a <{i}>x <{99_999 - i}>77" if 99_999 - i > 9999 else f"a <{i}>x <{(99_999 - i)}7>7" for i in range(2000)]
