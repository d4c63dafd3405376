"""Whitening against exact sums and a symmetric eigensolver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA)
    return made.withColumns({c: F.lit(c) for c in ("size", "n", "id", "value", "component", "x.y", "a b")})


def whitened(spark, rows):
    vectors = frame(spark, rows)
    return whitening.whiten(vectors, whitening.fit(spark, vectors)).orderBy("vec_id", "component").collect()


def plain(rows):
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1).tolist(), c @ vectors, values


def drawn(n, size, seed):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, size)) * np.logspace(0, -2, size) @ np.linalg.qr(r.normal(size=(size, size)))[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]


def test_equals_eigensolver(spark, monkeypatch):
    rows = drawn(700, 12, 1)
    for block in (whitening.BLOCK, 200):
        monkeypatch.setattr(whitening, "BLOCK", block)
        got = whitened(spark, rows)
        n, deviations, projected, values = plain(rows)
        assert [(r["vec_id"], r["component"]) for r in got] == [(i, k) for i in range(n) for k in range(1, 9)]
        assert [r["deviation"] for r in got[::8]] == deviations == [int(r["deviation_exact"]) for r in got[::8]]
        w = np.array([r["whitened"] for r in got]).reshape(n, 8)
        want = projected[:, :8] / np.sqrt(values[:8])
        assert np.allclose(np.abs(w), np.abs(want), atol=1e-9)
        assert np.allclose([r["explained"] for r in got[:8]], values[:8] / values.sum(), rtol=1e-10)
        assert got[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in got}) == 1


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = drawn(40, 3, 2) + [(0, [1.0, 2.0, 3.0])] * 3 + [(None, [0.5, -0.5, 0.25])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 0.0, 0.0]), (94, [0.0, inf, 0.0]), (95, [0.0, -inf, 0.0]), (96, [1.0, 2.0]), (97, [1.0] * 5)]
    got = whitened(spark, good + bad)
    n, deviations, _, _ = plain(good)
    assert len(got) == 3 * n and got[0]["n"] == n == 44
    assert sorted(r["deviation"] for r in got) == sorted(d for d in deviations for _ in range(3))
    assert sum(r["vec_id"] is None for r in got) == 3
    assert whitened(spark, []) == [] == whitened(spark, bad[:3])


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(i, [0.25, 0.5, 0.75]) for i in range(9)]])
def test_no_deviation(spark, rows):
    got = whitened(spark, rows)
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in got} == {(0.0, 0.0, 0, 0.0)}


def test_dependent_columns(spark):
    rows = [(i, [v[0], v[0], v[1]]) for i, v in drawn(200, 2, 3)]
    got = whitened(spark, rows)
    assert {r["whitened"] for r in got if r["component"] == 3} == {0.0}
    assert got[0]["identity_error"] < 1e-10


def test_huge_entries_are_exact(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [1e15, -7.0]), (3, [5.0, 2e9])]
    got = whitened(spark, rows)
    x = [[(1 << 63) - 1, 100_000], [-(1 << 63), 101_024], [int(np.float32(1e15)) * 1024 + 100_000, 100_000 - 7168], [105_120, 2_000_000_000 * 1024 + 100_000]]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((4 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    assert [r["deviation"] for r in got[::2]] == [d if d < 1 << 63 else None for d in exact]
    assert all(np.isfinite(r["whitened"]) for r in got)
    rows = [(i, [c * 5e4 for c in v]) for i, v in drawn(300, 4, 5)]
    assert [int(r["deviation_exact"]) for r in whitened(spark, rows)[::4]] == plain(rows)[1]


def test_jacobi_keeps_small_deviations():
    r = np.triu(np.random.default_rng(4).normal(size=(9, 9))) * np.logspace(0, -9, 9)
    lengths, rotations = whitening.jacobi(r)
    assert np.allclose(rotations.T @ rotations, np.eye(9), atol=1e-13)
    assert np.allclose(lengths, np.linalg.svd(r, compute_uv=False), rtol=1e-6, atol=1e-15)
    assert np.allclose((r @ rotations).T @ (r @ rotations), np.diag(lengths**2), atol=1e-13)


def test_whole_table(spark, tiny):
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, tiny)
    assert got.count() == 8 * vectors.count()
    assert got.select("identity_error").distinct().first()[0] < 1e-10
