"""Removal of repeated passages against plain code."""

import hashlib

import pytest

from linewright.llm import substrings


def plain(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [4 << 20, 700])
def test_against_plain_code(spark, edge_rows, sentences, monkeypatch, chunk):
    """With small chunks, copies of a passage meet in the buckets, of which there are many, instead of within a chunk."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000 if chunk < 1000 else substrings.BUCKET_BYTES)
    passage = sentences(14, 90)
    rows = [(i, t) for i, t, *_ in edge_rows if chunk > 1000 or i != 11]
    rows += [(500 + i, f"{sentences(i, 600 + i)} {passage} {sentences(40 - i, 700 + i)}") for i in range(40)]
    rows += [(600, " ".join(passage.split()[:12])), (601, " ".join(passage.split()[:13])), (602, f"{passage} {passage}"), (603, "w " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sha = substrings._located(spark, frame).mapInArrow(substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert sorted((tuple(r) for r in sha.collect()), key=repr) == plain(rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = substrings.remove_repeats(spark, edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["kept_text"] == "" and by_id[1]["n_removed"] == 0 and by_id[10]["n_removed"] == 60
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)
    assert substrings.remove_repeats(spark, no_docs).count() == 0


def test_hashes_that_agree_in_part_are_told_apart():
    import numpy as np

    ids, hashes, more = np.array([1, 2, 3, 4]), np.array([9, 9, 9, 8], np.uint64), np.array([5, 6, 5, 5], "<u4")
    assert substrings._later(ids, hashes, more).tolist() == [False, False, True, False]


def _gone_bytes(spark, copies, words):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(words))
    frame = spark.createDataFrame([(0, text)] + [(5, text)] * copies + [(6, "a b c")] * 3 + [(None, text)] * 2, "doc_id long, text string")
    located = substrings._located(spark, frame)
    rows = located.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("gone")).alias("b"), F.max(F.length("gone")).alias("most")).collect()
    return {r["doc_id"]: (r["n"], r["b"], r["most"]) for r in rows}


def test_repeated_rows_cost_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(substrings, "REPEATS", 64)
    each = 4 * (300 - 12)
    for copies in (100, 3000):
        assert _gone_bytes(spark, copies, 300) == {0: (1, None, None), 5: (copies, copies * each, each), 6: (3, None, None), None: (2, None, None)}


def test_rows_under_one_key_are_told_apart(spark, monkeypatch, sentences):
    """With keys of a few values nearly all rows clash; the further bits tell them apart."""
    from pyspark.sql import functions as F

    rows = [(i, sentences(30, i % 7)) for i in range(20)] + [(3, sentences(30, 3))]
    keyed = substrings._keyed

    monkeypatch.setattr(substrings, "_keyed", lambda docs: keyed(docs).withColumn("key", F.col("key") % 3))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sha = substrings._located(spark, frame).mapInArrow(substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert sorted((tuple(r) for r in sha.collect()), key=repr) == plain(rows)
