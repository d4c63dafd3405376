"""Whitening of embeddings by one-sided Jacobi rotations of a blockwise TSQR factor.

Entries become whole numbers, so the mean is exact: with S = n * m + r (0 <= r < n) a row
is centred as (x - m) - r / n, which loses nothing to cancellation. Every task folds its
centred rows, block by block, into one triangular factor R; factors are stacked and
factored again in groups of ``FAN`` until one is left. Plane rotations then make the
columns of R orthogonal: their lengths are the standard deviations (times the root of n),
the accumulated rotations are the components. The covariance is never formed, so small
deviations keep their digits. Only matrices of the size of the dimension reach the driver.

The covariance of the whitened rows is measured over all of them, as means and centred
products that are merged in the same groups; ``identity_error`` is its distance from the
identity.

Cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped,
and so are rows whose length is not the most frequent one (of equally frequent ones the
longer). 1024 * c is cut off at the range of a long. A component without any deviation
(one row, equal rows, dependent columns) has whitened and explained 0 and is left out of
identity_error. ``deviation`` is null where it does not fit a long; ``deviation_exact``
(a decimal, null from 10**38 on) then has it. A null vec_id stays null; repeated rows are
rows. An empty table gives no rows. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Factors that one task stacks, and entries of a block of rows.
FAN, BLOCK = 16, 1 << 20
#: Columns count as orthogonal from this cosine on, and as zero below this part of the longest.
COSINE, NOTHING = 1e-15, 1e-12
SWEEPS = 60

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """What projects a vector: counts and sums, whole and rest of the mean, components, deviations."""

    n: int
    size: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray  # size x components
    lengths: np.ndarray  # of the rotated columns: root of n times the standard deviation
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, centred: np.ndarray) -> np.ndarray:
        scale = np.where(self.lengths > 0, np.sqrt(self.n) / np.where(self.lengths > 0, self.lengths, 1), 0)
        return (centred @ self.components) * scale


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose entries are all numbers."""
    number = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(number)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 of doubles, cut off at the range of a long."""
    with np.errstate(over="ignore"):
        low = np.floor(entries * SCALE)
    inside = np.clip(low, -(2.0**62), 2.0**62).astype(np.int64) + SHIFT
    inside[low >= 2.0**62] = _MOST
    inside[low <= -(2.0**62)] = _LEAST
    return inside


def _matrices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number rows) of the vectors of one length, in blocks of BLOCK entries."""
    column = batch.column(1)
    rows = np.flatnonzero(np.asarray(column.value_lengths()) == size)
    per = max(2 * size, BLOCK // size)
    for at in range(0, len(rows), per):
        part = rows[at : at + per]
        yield part, whole_numbers(column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length met: rows, and the sums as high and low halves, so none overflows."""
    found: dict[int, list] = {}
    for batch in batches:
        for size in np.unique(np.asarray(batch.column(1).value_lengths())).tolist():
            n, high, low = found.setdefault(size, [0, np.zeros(size, np.int64), np.zeros(size, np.int64)])
            for part, x in _matrices(batch, size):
                n += len(part)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
            found[size][0] = n
    if found:
        columns = zip(*((size, n, high.tolist(), low.tolist()) for size, (n, high, low) in found.items()), strict=True)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["size", "n", "high", "low"])


def _exact_mean(spark: SparkSession, rows: DataFrame) -> tuple[int, int, list[int]] | None:
    """(size, n, sums) of the most frequent length."""
    parts = tables.cut(spark, rows.mapInArrow(_sums, "size long, n long, high array<long>, low array<long>"), "whitening-sums")
    most = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    pairs = parts.filter(F.col("size") == most["size"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("place", "pair"))
    wide = [F.sum(F.col(f"pair.{half}").cast("decimal(20,0)")).alias(half) for half in ("high", "low")]
    sums = [0] * most["size"]
    for r in pairs.groupBy("place").agg(*wide).collect():  # a row for each dimension
        sums[r["place"]] = int(r["high"]) * (1 << 32) + int(r["low"])
    return most["size"], most["n"], sums


def _offsets(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x - m as longs, or as Python's whole numbers where those would overflow."""
    far = np.abs(whole.astype(float)).max() + np.abs(x.astype(float)).max()
    return x - whole if far < 2.0**62 else x.astype(object) - whole.astype(object)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _offsets(x, model.whole).astype(float) - model.rest.astype(float) / model.n


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S)**2, exactly: n**2 |y|**2 - 2 n y.r + |r|**2 with y = x - m."""
    y = _offsets(x, whole)
    most = float(np.abs(y).max()) if y.size else 0.0
    if y.dtype != object and (most * most * y.shape[1] >= 2.0**62 or most * float(rest.max()) * y.shape[1] >= 2.0**62):
        y = y.astype(object)
    r = rest.astype(object) if y.dtype == object else rest
    squares, mixed, last = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(int(v) ** 2 for v in rest)
    return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]


def _tree(spark: SparkSession, parts: DataFrame, merge: Callable[[list[bytes]], bytes], label: str) -> bytes:
    """Merge (id, value) rows in groups of FAN, in order of their ids, until one is left."""

    def group(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("id").to_pylist(), table.column("value").to_pylist(), strict=True))
        return pa.table({"id": pa.array([rows[0][0] // FAN], pa.int64()), "value": pa.array([merge([v for _, v in rows])], pa.binary())})

    parts = tables.cut(spark, parts, label)
    while parts.count() > 1:
        merged = parts.withColumn("_group", F.floor(F.col("id") / FAN)).groupBy("_group").applyInArrow(group, "id long, value binary")
        parts = tables.cut(spark, merged, label)
    return bytes(parts.first()["value"])


def _part(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], ["id", "value"])


def _factor(spark: SparkSession, rows: DataFrame, model: Whitening) -> np.ndarray:
    """The triangular factor of all centred rows."""
    size = model.size

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for _, x in _matrices(batch, size):
                r = np.linalg.qr(np.vstack((r, _centred(x, model))), mode="r")
        if len(r):
            yield _part(r.tobytes())

    def merge(values: list[bytes]) -> bytes:
        r = np.zeros((0, size))
        for v in values:
            r = np.linalg.qr(np.vstack((r, np.frombuffer(v).reshape(-1, size))), mode="r")
        return r.tobytes()

    return np.frombuffer(_tree(spark, rows.mapInArrow(fold, "id long, value binary"), merge, "whitening-r")).reshape(-1, size)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotate the columns of r until they are orthogonal: (their lengths, the rotations), longest first.

    A step rotates disjoint pairs of columns at once; the round-robin order meets every
    pair once in a sweep.
    """
    size = r.shape[1]
    a, v = np.array(r, float), np.eye(size)
    order = np.arange(size + size % 2)  # an even number of seats, the last one may stay empty
    for _ in range(SWEEPS if size > 1 else 0):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            both = (p < size) & (q < size)
            p, q = p[both], q[both]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            live = np.abs(gamma) > COSINE * np.sqrt(alpha) * np.sqrt(beta) * np.sqrt(size)
            if live.any():
                turned = True
                p, q, ap, aq = p[live], q[live], ap[:, live], aq[:, live]
                zeta = (beta[live] - alpha[live]) / (2 * gamma[live])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0))
    by = np.argsort(-lengths, kind="stable")
    return lengths[by], v[:, by]


def _measured(spark: SparkSession, rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened rows, minus the identity."""
    k = len(model.lengths)

    def join(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def pack(m: tuple[float, np.ndarray, np.ndarray]) -> bytes:
        return np.concatenate(([m[0]], m[1], m[2].ravel())).tobytes()

    def unpack(value: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        flat = np.frombuffer(value)
        return float(flat[0]), flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part, x in _matrices(batch, model.size):
                w = model.project(_centred(x, model))
                mean = w.mean(axis=0)
                now = (float(len(part)), mean, (w - mean).T @ (w - mean))
                held = now if held is None else join(held, now)
        if held is not None:
            yield _part(pack(held))

    def merge(values: list[bytes]) -> bytes:
        held = unpack(values[0])
        for v in values[1:]:
            held = join(held, unpack(v))
        return pack(held)

    n, _, products = unpack(_tree(spark, rows.mapInArrow(fold, "id long, value binary"), merge, "whitening-moments"))
    live = model.lengths > 0
    off = np.abs(products / n - np.eye(k))[np.ix_(live, live)]
    return float(off.max()) if off.size else 0.0


def fit(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None where there are none."""
    rows = usable(vectors)
    found = _exact_mean(spark, rows)
    if found is None:
        return None
    size, n, sums = found
    k = min(components, size)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    model = Whitening(n, size, whole, rest, np.zeros((size, k)), np.zeros(k), np.zeros(k))
    lengths, rotations = jacobi(_factor(spark, rows, model))
    lengths = np.where(lengths > NOTHING * lengths[0], lengths, 0)
    rotations = rotations * np.where(rotations[np.abs(rotations).argmax(axis=0), np.arange(size)] < 0, -1, 1)
    total = float((lengths**2).sum())
    model = replace(model, components=rotations[:, :k], lengths=lengths[:k], explained=lengths[:k] ** 2 / total if total else np.zeros(k))
    return replace(model, identity_error=_measured(spark, rows, model))


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each usable vector and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    k = len(model.lengths)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _OUT.split(", ")]
        for batch in batches:
            ids = np.asarray(batch.column(0).is_valid()), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for part, x in _matrices(batch, model.size):
                count = len(part)
                w = model.project(_centred(x, model))
                exact = deviations(x, model.n, model.whole, model.rest)
                each = np.repeat(np.arange(count), k)
                fits = pa.array([d if d <= _MOST else None for d in exact], pa.int64())
                wide = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
                columns = [
                    pa.array(ids[1][part][each], pa.int64(), mask=~ids[0][part][each]),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, model.n, np.int64)),
                    fits.take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * k, model.identity_error)),
                    wide.take(pa.array(each)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return usable(vectors).mapInArrow(rows_of, _OUT)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(spark, vectors))
