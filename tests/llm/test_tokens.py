"""Token ids, length histogram and packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linewright.llm import encoding, lengths, packing


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(encoding.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(reference, edge_rows):
    encoder = encoding.encoder(encoding.default_path())
    random.seed(0)
    letters = " \n\t\r  　\xa0aZé漢字12²'s're!?<|endoftext|>\0 ​😀¼Ⅷ़"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 20))) for _ in range(3000)] + [t for _, t, *_ in edge_rows]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == reference(text)


def test_very_long_runs(reference):
    encoder = encoding.encoder(encoding.default_path())
    n = 2_000_000
    mixed = "<|endoftext|>" + " " * 150_000 + "<|endoftext|>" + "\n" * 150_000 + "the " + "\u3000" * 120_000
    for text in (" " * n, "\n" * n, "a" * n, "x" + " " * n + "y", "x" + "\n" * n + "!", mixed):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == reference(text)


def test_context_limits_by_brute_force(spark, edge_docs, edge_rows, reference):
    counts = Counter(len(reference(t)) for _, t, *_ in edge_rows)
    every = list(counts.elements())
    rows = lengths.context_limits(lengths.histogram(lengths.token_lengths(edge_docs, encoding.default_path()))).collect()
    assert {r["context_limit"]: r["n_docs"] for r in rows} == counts
    for r in rows:
        limit = r["context_limit"]
        assert r["total_tokens"] == sum(every)
        assert r["docs_over"] == sum(n > limit for n in every)
        assert r["tokens_over"] == sum(n for n in every if n > limit)
        assert r["truncated_total"] == sum(min(n, limit) for n in every)
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in every) / len(every))


def test_no_documents(spark, no_docs):
    assert lengths.context_limits(lengths.histogram(lengths.token_lengths(no_docs, encoding.default_path()))).count() == 0
    assert packing.pack_documents(no_docs).count() == 0


def check_packing(rows, ids, capacity):
    """Pieces cover their documents, sequences are gapless, checksums fit."""
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, n_rows, own in ids:
        own = np.array([*own, 2], "<u4")
        cuts = packing.cut_points(len(own), capacity)
        assert sum(n for _, n in cuts) == len(own)
        for k, (start, length) in enumerate(cuts):
            assert (start, length, zlib.crc32(own[start : start + length].tobytes())) in pieces[doc_id, k]
    return len(sequences)


def test_packing(spark, edge_docs, edge_rows, reference):
    rows = packing.pack_documents(edge_docs).collect()
    ids = [(i, 1, reference(t)) for i, t, *_ in edge_rows]
    assert len(rows) == sum(len(packing.cut_points(len(x) + 1, 1024)) for _, _, x in ids)
    assert all(r["length"] < 1024 or r["offset"] == 0 for r in rows)
    n = check_packing(rows, ids, 1024)
    assert n <= -(-sum(len(x) + 1 for _, _, x in ids) // 1024) + 2


def test_cut_points():
    assert packing.cut_points(1, 4) == [(0, 1)]
    assert packing.cut_points(4, 4) == [(0, 4)]
    assert packing.cut_points(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut_points(8, 4) == [(0, 4), (4, 4)]


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.OpenBins(2)
    assert bins.place(6, 10, 0) == (0, 0, True)
    assert bins.place(7, 10, 1) == (1, 0, True)
    assert bins.place(3, 10, 2) == (1, 7, False)  # the tighter of the two; it is full now
    assert bins.place(8, 10, 2) == (2, 0, True)
    assert bins.place(5, 10, 3) == (3, 0, True)  # bin 2 was the fullest and closes
    assert bins.place(2, 10, 4) == (0, 6, False)


def test_packing_wastes_little(spark, tiny):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.005 * -(-total // 1024) + 1


def test_the_bound_binds_and_many_lanes_pack_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = packing.pieces(docs, encoding.default_path()).cache()
    total = made.agg({"length": "sum"}).first()[0]
    counts = {}
    for bins in (8, packing.OPEN_BINS):
        rows = packing.pack(made, 3, open_bins=bins).collect()
        assert len(rows) == made.count() and {(r["doc_id"], r["piece"]) for r in rows} == {(r["doc_id"], r["piece"]) for r in made.collect()}
        counts[bins] = len({r["sequence_id"] for r in rows})
    assert counts[8] > counts[packing.OPEN_BINS]  # bins close before they are full
    assert counts[packing.OPEN_BINS] <= 1.005 * -(-total // 1024)
    made.unpersist()
