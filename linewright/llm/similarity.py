"""Similarity join on word five-grams: MinHash bands, Bayesian pruning, exact verification.

1. Texts are lower-cased and split at ASCII white space; a document is the set of its
   five-word shingles (of all its words where it has fewer than five). Documents with the
   same words in the same order form one group of copies and go on as one representative.
2. 128 MinHash values in 32 bands of 4: a pair at similarity 0.8 misses every band with a
   probability below 1e-7. Bands that one representative has alone go; of a large band,
   members are dealt to blocks and the pairs of blocks to tasks.
3. A pair is a candidate in the first band that it shares, and in no other. There its
   MinHash values are compared 16 at a time. With m of n equal and a uniform prior, the
   posterior probability that the similarity reaches the threshold is
   P(Bin(n + 1, threshold) <= m); pairs go as soon as it falls below the tolerance.
4. What is left is verified on the shingle sets, by jobs: the members of at most two tiles
   of ``TILE`` representatives, each with a bit for every partner. Only members of a job
   send their shingles. Pairs never become rows: each job returns the number of links and
   the smallest linked member of each document.
5. Verified links bind documents into classes.

Result: one row for each document with class_id (the smallest doc_id of its class) and
n_links (other documents, copies included, at or above the threshold).

Cases: a null text or one without words has no shingles, no links and a class of its
own, and so has a row with a null doc_id (with class null). Repeated rows count as
copies, and so do rows of the same words with other ids; texts that differ under one
doc_id are documents of their own. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm import graph, tables, textkit

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
#: Members of a block: a part of the band, within these bounds.
BLOCK_PART, BLOCK_LEAST, BLOCK_MOST = 32, 256, 8192
BLOCK_SHINGLES = 4_000_000
TILE = 512
CHUNK_BYTES = 4 << 20
PAIRS_AT_ONCE = 200_000

_draws = np.random.default_rng(20240229)
_FACTORS = _draws.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draws.integers(0, 1 << 63, HASHES, np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """For each text its distinct shingle hashes, sorted, and a 128-bit key of its words."""
    data, offsets = textkit.text_bytes(pc.utf8_lower(column))
    for i, j in textkit.row_ranges(offsets, CHUNK_BYTES):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = textkit.words(part, bounds)
        hashes = textkit.word_hashes(part, starts, ends)
        windows = textkit.window_hashes(hashes, SHINGLE)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e == s:
                yield np.empty(0, np.uint64), (0, 0)
                continue
            own = hashes[s:e]
            turn = textkit.mix(own + np.arange(e - s, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key = (int(turn.sum()), int((turn * (turn | np.uint64(1))).sum()))
            found = windows[s : e - SHINGLE + 1] if e - s >= SHINGLE else textkit.window_hashes(own, e - s)
            yield np.unique(found), key


def minhash(shingles: np.ndarray) -> bytes:
    """HASHES values of 16 bits: the low bits of the least of 32-bit hashes."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(shingles), 2048):
        values = ((shingles[s : s + 2048, None] * _FACTORS + _TERMS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, values.min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the fewest equal values at which a pair stays."""
    kept = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        kept.append(m)
    return np.array(kept)


def plausible(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indexes of the pairs (a, b) that no round of comparisons drops."""
    alive = []
    for s in range(0, len(a), PAIRS_AT_ONCE):
        pairs = np.arange(s, min(len(a), s + PAIRS_AT_ONCE))
        equal = np.zeros(len(pairs), np.int32)
        for k, fewest in enumerate(least):
            values = slice(k * STEP, (k + 1) * STEP)
            equal += (signatures[a[pairs], values] == signatures[b[pairs], values]).sum(axis=1, dtype=np.int32)
            stay = equal >= fewest
            pairs, equal = pairs[stay], equal[stay]
        alive.append(pairs)
    return np.concatenate(alive) if alive else np.empty(0, np.int64)


def _described(docs: DataFrame) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            columns: tuple[list, ...] = ([], [], [], [])
            for valid, (shingles, key) in zip(ids.is_valid().to_pylist(), shingle_sets(batch.column(1))):
                known = valid and len(shingles) > 0
                values = (_signed(key[0]), _signed(key[1]), len(shingles), minhash(shingles)) if known else (None, None, 0, None)
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "k1", "k2", "n_shingles", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(describe, "doc_id long, k1 long, k2 long, n_shingles int, signature binary")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(rows: DataFrame, n: int, blocks: Column) -> DataFrame:
    """Each member of a band once for each pair of blocks (lo, hi) that its block is in, in order of the pair."""
    placed = rows.withColumn("_blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = placed.withColumn("_other", other).withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
    return dealt.drop("_blocks", "_other").repartition(n, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "rep")


def _edges(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1


def _in_groups(group: tuple[str, ...], answer: Callable[[pa.Table, np.ndarray], pa.RecordBatch]):
    """Run ``answer`` on runs of whole groups; rows come sorted by the columns of group."""
    keys_of = lambda rows: np.stack([rows.column(c).to_numpy().astype(np.int64) for c in group])

    def answered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return answer(table, np.concatenate(([0], _edges(keys_of(table)), [table.num_rows])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = keys_of(batch)
            edges = _edges(keys)
            if held and tuple(keys[:, 0]) != last:
                yield answered(held)
                held = []
            last = tuple(keys[:, -1])
            if len(edges):
                held.append(batch.slice(0, edges[-1]))
                yield answered(held)
                held = [batch.slice(edges[-1])]
            else:
                held.append(batch)
        if held:
            yield answered(held)

    return each


def _signatures(table: pa.Table) -> np.ndarray:
    column = table.column("signature").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, "<u2", len(column) * HASHES, first).reshape(-1, HASHES)


def _tiles(blocks: np.ndarray, lo: int, hi: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group, within a block or across its two blocks, tile by tile."""
    cut = lambda members: [members[i : i + size] for i in range(0, len(members), size)]
    if lo == hi:
        parts = cut(np.arange(len(blocks)))
        for i, left in enumerate(parts):
            x, y = np.triu_indices(len(left), 1)
            yield left[x], left[y]
            for right in parts[i + 1 :]:
                yield np.repeat(left, len(right)), np.tile(right, len(left))
    else:
        for left in cut(np.flatnonzero(blocks == lo)):
            for right in cut(np.flatnonzero(blocks == hi)):
                yield np.repeat(left, len(right)), np.tile(right, len(left))


def _first_shared(bands: np.ndarray, x: np.ndarray, y: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which pairs share no band before the one at hand (number, by row)."""
    alive = np.arange(len(x))
    for j in range(int(number.max()) if len(x) else 0):
        alive = alive[(number[x[alive]] <= j) | (bands[x[alive], j] != bands[y[alive], j])]
    return alive


_JOB = ("band", "lo", "hi", "tile")
_JOBS = "band long, lo int, hi int, tile int, rep long, place int, partners binary"
_JOB_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())


def _candidates(least: np.ndarray, size: int = TILE):
    """Jobs of the plausible pairs in the bands at hand: a row for each member, with bits for its partners behind it."""

    def answer(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        signatures, reps = _signatures(table), table.column("rep").to_numpy()
        bands = signatures.view(np.uint64)
        band, block, lo, hi, number = (table.column(c).to_numpy() for c in ("band", "block", "lo", "hi", "number"))
        out: tuple[list, ...] = ([], [], [], [], [], [], [])

        def settled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = _first_shared(bands, x, y, number)
            x, y = x[first], y[first]
            stay = plausible(signatures, x, y, least)
            return x[stay], y[stay]

        def put(row: int, tile: int, place: int, partners: bytes) -> None:
            for column, value in zip(out, (band[row], lo[row], hi[row], tile, reps[row], place, partners)):
                column.append(value)

        sizes = np.diff(edges)
        twos = edges[:-1][(sizes == 2) & (lo[edges[:-1]] == hi[edges[:-1]])]
        for x, y in zip(*(v.tolist() for v in settled(twos, twos + 1))):
            put(x, 0, 0, b"\x02")
            put(y, 0, 1, b"")
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s < 2 or e - s == 2 and lo[s] == hi[s]:
                continue
            for tile, (x, y) in enumerate(_tiles(block[s:e], lo[s], hi[s], size)):
                x, y = settled(x + s, y + s)
                if not len(x):
                    continue
                members, places = np.unique(np.concatenate((x, y)), return_inverse=True)
                bits = np.zeros((len(members), len(members)), bool)
                bits[places[: len(x)], places[len(x) :]] = True
                for place, (row, own) in enumerate(zip(members.tolist(), np.packbits(bits, axis=1, bitorder="little"))):
                    put(row, tile, place, own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _JOB_KINDS)], [f.split()[0] for f in _JOBS.split(", ")])

    return answer


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, summed over slices of the common ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    common = count[place] > 1
    owner, column = owner[common], rank[place[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (s, s + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[i:j], column[i:j] - s] = 1
        total += dense @ dense.T
    return total


def _verify(threshold: float):
    """For each member with links in a job: their number, copies included, and the smallest member bound."""

    def answer(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        packed, partners = table.column("shingles").combine_chunks(), table.column("partners").to_pylist()
        out: tuple[list, ...] = ([], [], [])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            found = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) for bits in partners[s:e]]
            x, y = np.repeat(np.arange(e - s), [len(f) for f in found]), np.concatenate(found)
            sets = [np.frombuffer(packed[k].as_buffer(), np.uint64) for k in range(s, e)]
            size = np.array([len(t) for t in sets])
            if len(x) > 2 * (e - s):
                both = _intersections(sets)[x, y]
            else:
                both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())])
            linked = both >= threshold * (size[x] + size[y] - both) - 1e-9
            x, y = x[linked], y[linked]
            links = np.zeros(e - s, np.int64)
            np.add.at(links, x, copies[s:e][y])
            np.add.at(links, y, copies[s:e][x])
            order = np.argsort(reps[s:e])
            rank = np.empty(e - s, np.int64)
            rank[order] = np.arange(e - s)
            roots = reps[s:e][order][graph.local_roots(e - s, rank[x], rank[y])][rank]
            some = np.flatnonzero(links)
            for column, values in zip(out, (reps[s:e][some], links[some], roots[some])):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out], ["rep", "links", "root"])

    return answer


def _with_shingles(members: DataFrame, described: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, copies, shingles): members with the shingle set of their words: one for each key, however many rows share the words or the doc_id."""

    def cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [])
            for shingles, key in shingle_sets(batch.column(0)):
                for column, value in zip(columns, (_signed(key[0]), _signed(key[1]), shingles.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "shingles"])

    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    counted = described.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    wanted = members.select(F.col("first").alias("_id")).distinct().join(counted, "_id")
    texts = tables.attach(ids, wanted, ["_id"], described.count(), "left_semi").select("text")
    # A doc_id may stand for several texts and a text in several rows; equal keys have equal sets.
    sets = texts.mapInArrow(cut_sets, "k1 long, k2 long, shingles binary").groupBy("k1", "k2").agg(F.min("shingles").alias("shingles"))
    return members.join(sets, ["k1", "k2"]).select("rep", "copies", "shingles")


def _placed(spark: SparkSession, docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The described rows, and for each key (k1, k2) of their words the smallest doc_id, copies, class and links."""
    n, least = tables.partitions(spark), least_matches(threshold, tolerance)
    described = tables.cut(spark, _described(docs), "signatures")
    known = described.filter(F.col("k1").isNotNull())
    reps = known.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min_by(F.struct("n_shingles", "signature"), "doc_id").alias("s")
    )
    # One number for each key, in place of its 128 bits; doc_ids need not be unique. The table fixes the numbers.
    reps = reps.sortWithinPartitions("k1", "k2").withColumn("rep", F.monotonically_increasing_id())
    reps = tables.cut(spark, reps.select("k1", "k2", "first", "rep", "copies", "s.n_shingles", "s.signature"), "representatives")

    width = 2 * ROWS
    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
    bands = reps.select("rep", "n_shingles", F.posexplode(values).alias("number", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("shingles")).filter(F.col("_n") > 1)
    per_block = F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), F.col("_n") / BLOCK_PART))
    shared = shared.withColumn("blocks", F.greatest(F.ceil(F.col("_n") / per_block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).drop("shingles")
    members = tables.attach(bands, shared, ["band"], BANDS * reps.count()).join(reps.select("rep", "signature"), "rep")
    dealt = _dealt(members, n, F.col("blocks")).select("band", "lo", "hi", "block", "number", "rep", "signature")
    jobs = tables.cut(spark, dealt.mapInArrow(_in_groups(("band", "lo", "hi"), _candidates(least, TILE)), _JOBS), "jobs")

    wanted = reps.join(jobs.select("rep").distinct(), "rep").select("rep", "k1", "k2", "first", "copies")
    asked = jobs.join(_with_shingles(wanted, described, docs), "rep").repartition(n, *_JOB).sortWithinPartitions(*_JOB, "place")
    asked = asked.select(*_JOB, "rep", "copies", "partners", "shingles")
    verified = tables.cut(spark, asked.mapInArrow(_in_groups(_JOB, _verify(threshold)), "rep long, links long, root long"), "links")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = graph.components(spark, verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    heads = joined.join(reps.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("_n"))
    joined = tables.attach(joined, heads, ["root"], joined.count())

    placed = reps.select("k1", "k2", "first", "rep", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    return described, placed.select(
        "k1", "k2", "first", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("class_id", "first").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs."""
    described, placed = _placed(spark, docs, threshold, tolerance)
    placed = tables.cut(spark, placed.select("k1", "k2", "class_id", "n_links", F.col("copies").alias("_n")), "classes")
    rows = described.select("doc_id", "k1", "k2")
    found = tables.attach(rows.filter(F.col("k1").isNotNull()), placed, ["k1", "k2"], described.count())
    alone = rows.filter(F.col("k1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, _id, _k1, _k2): whole rows with the key of their words, null where there are none."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(_signed(k[0]), _signed(k[1])) if len(found) else (None, None) for found, k in shingle_sets(batch.column(2))]
            halves = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *halves], ["row", "_id", "_k1", "_k2"])

    rows = docs.select(F.struct(*tables.columns(docs)).alias("row"), docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    kind = T.StructType([T.StructField("row", docs.schema, False), *(T.StructField(c, T.LongType()) for c in ("_id", "_k1", "_k2"))])
    return rows.mapInArrow(key, kind)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns it came with: one of those with the smallest doc_id.

    Rows with a null doc_id belong to no class and all stay. Rows without words are a class
    for each doc_id. Of rows that share the smallest doc_id, the one of the least key of
    words stays, and of those with equal words the first by text and by the row as JSON.
    """
    described, placed = _placed(spark, docs, THRESHOLD, TOLERANCE)
    firsts = placed.groupBy("root").agg(F.min(F.struct("first", "k1", "k2")).alias("f")).select(F.col("f.first").alias("doc_id"), "f.k1", "f.k2")
    owned = described.filter(F.col("doc_id").isNotNull())
    wordless = owned.filter(F.col("k1").isNull()).select("doc_id", "k1", "k2").distinct()
    chosen = firsts.unionByName(wordless).withColumn("stays", F.lit(True))
    fates = owned.groupBy("doc_id").agg(F.count("*").alias("n")).join(chosen, "doc_id", "left")
    fates = tables.cut(spark, fates, "fates")

    # A doc_id of one row decides by itself (null ones pass); rows of repeated doc_ids are told apart by their words.
    gone = fates.filter("n > 1 OR stays IS NULL").select(F.col("doc_id").alias("_gone")).distinct()
    single = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    again = fates.filter("n > 1 AND stays")
    ids = again.select(F.col("doc_id").alias("_again")).distinct()
    rows = _keyed(docs.join(ids, docs["doc_id"].cast("long") == ids["_again"], "left_semi"))
    same = (rows["_id"] == again["doc_id"]) & rows["_k1"].eqNullSafe(again["k1"]) & rows["_k2"].eqNullSafe(again["k2"])
    rows = rows.join(again, same, "left_semi").groupBy("_id", "_k1", "_k2")
    one = rows.agg(F.min_by("row", F.struct(F.col("row.text"), F.to_json("row"))).alias("row"))
    return single.unionByName(one.select("row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, tables.read(spark, sf_dir, "documents"))
