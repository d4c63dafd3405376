"""Removal of repeated passages by fixed-block anchors.

A passage repeats where ``WINDOW`` words in a row also start in a document with a
smaller doc_id. Every such window holds, in the document it repeats, one whole block of
``BLOCK`` words at a multiple of ``BLOCK`` (2 * BLOCK - 1 = WINDOW). So:

1. Each document is a reference by its non-overlapping blocks and a probe by all its
   rolling windows of BLOCK words. Hashes meet in buckets of the hash space; a block that
   some other window equals is an anchor of its document.
2. Anchors are extended: every WINDOW-word window around an anchor is hashed, and the
   smallest doc_id of each such hash is found, again in buckets. A run of such windows is
   a maximal exact repeat.
3. The windows that a smaller document has go back to their documents, and the words
   that they cover go.

Hashes travel packed, one row for a chunk of documents and a bucket, and so do answers.
Each chunk aggregates first: it sends every distinct block hash once and, of a longer
window that many of its documents share, what its smallest document has; what the others
need is already known. So a passage that a third of all rows share adds one entry for
each chunk to its bucket.

Buckets grow in number with the bytes of the texts (one for ``BUCKET_BYTES``, or more where
a shuffle has more partitions), so a task holds one bucket of bounded size at a time, and
step 1 tells blocks apart by 32 bits besides the bucket: chance anchors, which cost a look
and decide nothing, stay as rare on any input. Hashes are of 96 bits in step 2; two
windows with equal hashes count as equal (of 10**13 windows, some two differ with a
probability under 0.001).

Cases: a null or empty text has no words and keeps nothing. Repeated rows with equal
doc_id do not remove each other; equal rows are treated once and come out as often as they
came in. A row with a null doc_id is kept whole and removes
nothing. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables, textkit

WINDOW = 13
BLOCK = 7
CHUNK_BYTES = 4 << 20
REPEATS = 1024
BUCKET_BYTES = 64 << 20
_OTHER_STEP = np.uint64(0x9FB21C651E98DF25)

PROBE, BLOCKED, KNOWN, ASKED = 0, 1, 2, 3
_PACKED = "bucket int, kind int, keys binary, ids binary, counts binary, hashes binary, at binary, more binary"
_NAMES = ["bucket", "kind", "keys", "ids", "counts", "hashes", "at", "more"]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


class Packed:
    """Collects packed rows: for one bucket the documents, their entries' hashes and places."""

    def __init__(self, buckets: int, hash_kind: type):
        self.buckets, self.hash_kind = np.uint64(buckets), hash_kind
        self.columns: list[list] = [[] for _ in _NAMES]

    def _sliced(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        ranked = bucket[order]
        edges = _runs(ranked)
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(ranked)]):
            yield int(ranked[s]), order[s:e]

    def _row(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def probes(self, hashes: np.ndarray) -> None:
        """Hashes that occur, whoever has them."""
        if len(hashes):
            for bucket, mine in self._sliced((hashes >> np.uint64(33)) % self.buckets):
                self._row(bucket, PROBE, b"", b"", b"", hashes[mine].astype(self.hash_kind).tobytes(), b"", b"")

    def add(self, kind: int, docs: np.ndarray, at: np.ndarray, hashes: np.ndarray | None, keys: np.ndarray, ids: np.ndarray | None, more: np.ndarray | None = None) -> None:
        """Entries in order of document: docs are indexes into keys and ids, at the word numbers.

        Entries with hashes go to the bucket of the hash, others to that of the document.
        """
        if not len(docs):
            return
        by = hashes >> np.uint64(33) if hashes is not None else textkit.mix(keys.view(np.uint64))[docs]
        for bucket, mine in self._sliced(by % self.buckets):
            own, places = docs[mine], at[mine]
            first = _runs(own)
            counts = np.diff(np.append(first, len(own)))
            self._row(
                bucket,
                kind,
                keys[own[first]].tobytes(),
                b"" if ids is None else ids[own[first]].tobytes(),
                counts.astype("u1" if int(counts.max()) < 256 else "<u4").tobytes(),
                b"" if hashes is None else hashes[mine].astype(self.hash_kind).tobytes(),
                places.astype("<u2" if int(places.max()) < 65536 else "<u4").tobytes(),
                b"" if more is None else more[mine].tobytes(),
            )

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], _NAMES)


def _narrow(raw: bytes, n: int) -> np.ndarray:
    """n numbers from as few bytes as they were packed in."""
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // n if n else 4]).astype(np.uint32)


def _unpack(rows: list[tuple], hash_kind: type) -> tuple[np.ndarray, ...]:
    """The entries of packed rows: document number, keys and ids by document, places, hashes, kinds, further bits of the hashes."""
    keys = [np.frombuffer(r[2], np.int64) for r in rows]
    counts = [_narrow(r[4], len(k)) for r, k in zip(rows, keys)]
    sizes = [int(c.sum()) if r[1] != PROBE else len(r[5]) // np.dtype(hash_kind).itemsize for r, c in zip(rows, counts)]
    begin = np.cumsum([0, *map(len, keys)])
    docs = [np.repeat(np.arange(b, b + len(c)), c) if r[1] != PROBE else np.full(n, -1) for r, c, b, n in zip(rows, counts, begin, sizes)]
    at = [_narrow(r[6], n) if r[1] != PROBE else np.zeros(n, np.uint32) for r, n in zip(rows, sizes)]
    hashes = [np.frombuffer(r[5], hash_kind) if r[5] else np.zeros(n, hash_kind) for r, n in zip(rows, sizes)]
    ids = [np.frombuffer(r[3], np.int64) if r[3] else k for r, k in zip(rows, keys)]
    kinds = np.repeat(np.array([r[1] for r in rows], np.int8), sizes)
    more = [np.frombuffer(r[7], "<u4") if r[7] else np.zeros(n if r[5] else 0, "<u4") for r, n in zip(rows, sizes)] if hash_kind is np.uint64 else []
    return tuple(np.concatenate(x) for x in (docs, keys, ids, at, hashes)) + (kinds, np.concatenate(more) if more else None)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the values, the start of each run of equals, and the run of each sorted entry."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, a key that tells rows apart by both, and 64 further bits to check it by."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, "text").alias("key"), F.xxhash64(F.lit(WINDOW), "text", doc_id).alias("check"), doc_id.alias("doc_id"), "text")


def _met_again(keyed: DataFrame) -> DataFrame:
    """(key, n, clash) of the keys of several rows: equal rows, or different ones that the further bits tell apart."""
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("check").alias("_lo"), F.max("check").alias("_hi"))
    return met.filter("n > 1").select("key", "n", (F.col("_lo") != F.col("_hi")).alias("clash"))


def _distinct(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (key, doc_id, text, n), each distinct one once, and whether any occurs n > 1 times.

    The first pass shuffles hashes only. Different rows under one key (none, or a few among
    10**10 rows) get keys made of 128 bits. Only where rows repeat are texts merged by key,
    in the tasks that read them first.
    """
    keyed = _keyed(docs)
    again = tables.cut(spark, _met_again(keyed), "repeated-rows")
    clashes = [r["key"] for r in again.filter("clash").collect()]
    if clashes:
        keyed = keyed.withColumn("key", F.when(F.col("key").isin(clashes), F.xxhash64("check", "key")).otherwise(F.col("key")))
        again = tables.cut(spark, _met_again(keyed), "repeated-rows")
    if again.isEmpty():
        return keyed.select("key", "doc_id", "text", F.lit(1).cast("long").alias("n")), False
    total = keyed.count()
    repeated = tables.attach(keyed, again.select("key", F.col("n").alias("_n")), ["key"], total, "left_semi")
    merged = repeated.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count("*").alias("n"))
    hot = again.filter(F.col("n") * tables.SHARE >= total).select("key")
    single = keyed.join(F.broadcast(hot), "key", "left_anti").join(again.select("key"), "key", "left_anti")
    return tables.cut(spark, merged.unionByName(single.select("key", "doc_id", "text", F.lit(1).cast("long").alias("n"))), "distinct-rows"), True


def _each_time(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Every row n times; a row of very many repeats is spread over tasks first."""
    once, many = rows.filter("n = 1"), rows.filter("n > 1")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS)))
    spread = many.withColumn("_part", part).repartition(tables.partitions(spark), "key", "_part")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("n") - F.col("_part") * REPEATS)))
    return once.unionByName(spread.withColumn("_copy", copies).drop("_part", "_copy"))


def _send_blocks(buckets: int):
    """Blocks and rolling windows of each chunk, every distinct hash once.

    A block that another entry of the chunk equals is an anchor already; its hash goes on
    as a probe for others. (An equal window of the same document makes an anchor too; it
    costs a look in step 2 and decides nothing.)
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            data, offsets = textkit.text_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in textkit.row_ranges(offsets, CHUNK_BYTES):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = textkit.words(part, bounds)
                hashes = textkit.window_hashes(textkit.word_hashes(part, starts, ends), BLOCK)
                places = np.flatnonzero(textkit.window_rows(first, BLOCK, len(hashes)))
                if not len(places):
                    continue
                hashes = hashes[places]
                docs = np.searchsorted(first, places, "right") - 1
                at = places - first[docs]
                aligned = at % BLOCK == 0
                order, begins, run = _groups(hashes)
                sizes = np.diff(np.append(begins, len(hashes)))
                n_blocks = np.add.reduceat(aligned[order].astype(np.int64), begins)
                out = Packed(buckets, np.uint32)
                alone = np.zeros(len(hashes), bool)
                alone[order] = (sizes == 1)[run]
                known = np.flatnonzero(aligned & ~alone)
                single = np.flatnonzero(aligned & alone)
                out.add(KNOWN, docs[known], at[known], None, keys[i:j], None)
                out.add(BLOCKED, docs[single], at[single], hashes[single], keys[i:j], None)
                out.probes(hashes[order[begins[(sizes > 1) | (n_blocks == 0)]]])
                yield out.batch()

    return send


def _buckets(hash_kind: type, targets: int, answer):
    """Run ``answer`` on the entries of each bucket; rows come sorted by bucket.

    The answer chooses entries; they go on packed by the bucket of their document.
    """

    def answered(held: list[tuple]) -> pa.RecordBatch:
        docs, keys, ids, at, hashes, kinds, more = _unpack(held, hash_kind)
        chosen = np.flatnonzero(answer(docs, ids, hashes, kinds, more))
        out = Packed(targets, hash_kind)
        out.add(KNOWN, docs[chosen], at[chosen], None, keys, None)
        return out.batch()

    return _each_bucket(answered)


def _each_bucket(answer):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return each


def _anchors(docs, ids, hashes, kinds, more) -> np.ndarray:
    """Blocks known to be anchors, and those that another chunk's entry equals."""
    hit = kinds == KNOWN
    met = np.flatnonzero(~hit)
    if len(met):
        order, begins, run = _groups(hashes[met])
        many = (np.diff(np.append(begins, len(met))) > 1)[run]
        hit[met[order]] = many & (kinds[met[order]] == BLOCKED)
    return hit


def _repeats(docs, ids, hashes, kinds, more) -> np.ndarray:
    """Windows known to repeat, and those that a smaller document of another chunk has."""
    gone = kinds == KNOWN
    met = np.flatnonzero(~gone)
    if len(met):
        gone[met] = _later(ids[docs[met]], hashes[met], more)
    return gone


def _by_document(held: list[tuple]) -> pa.RecordBatch:
    """One row (key, places) for each document among the packed entries of a bucket."""
    docs, keys, _, at, *_ = _unpack(held, np.uint32)
    key = keys[docs]
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    offsets = np.append(first, len(key)).astype(np.int32) * 4
    places = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at[order].astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(key[order][first]), places], ["key", "at"])


def _send_windows(buckets: int):
    """The windows around anchors, hashed; of each hash only what the smallest document of the chunk has goes on."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.text_bytes(batch.column("text"))
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            anchors = batch.column("anchors").to_pylist()
            for i, j in textkit.row_ranges(offsets, CHUNK_BYTES):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = textkit.words(part, bounds)
                by_word = textkit.word_hashes(part, starts, ends)
                hashes = textkit.window_hashes(by_word, WINDOW)
                if not len(hashes):
                    continue
                found = [first[d] + np.frombuffer(anchors[i + d], "<u4").astype(np.int64) for d in range(j - i)]
                # A window that repeats holds one whole block of its own document, and that block is an anchor.
                near = textkit.runs_to_mask(np.maximum(np.concatenate(found) - (WINDOW - BLOCK), 0), WINDOW - BLOCK + 1, len(hashes))
                places = np.flatnonzero(near & textkit.window_rows(first, WINDOW, len(hashes)))
                if not len(places):
                    continue
                hashes, more = hashes[places], (textkit.window_hashes(by_word, WINDOW, _OTHER_STEP)[places] >> np.uint64(32)).astype("<u4")
                docs = np.searchsorted(first, places, "right") - 1
                at = places - first[docs]
                later = _later(ids[i:j][docs], hashes, more)
                out = Packed(buckets, np.uint64)
                known, rest = np.flatnonzero(later), np.flatnonzero(~later)
                out.add(KNOWN, docs[known], at[known], None, keys[i:j], ids[i:j])
                out.add(ASKED, docs[rest], at[rest], hashes[rest], keys[i:j], ids[i:j], more[rest])
                yield out.batch()

    return send


def _later(ids: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """True for entries whose hash a smaller id has too."""
    order = np.lexsort((more, hashes))
    high, low = hashes[order], more[order]
    new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    later = np.empty(len(hashes), bool)
    later[order] = ids[order] > least[np.cumsum(new) - 1]
    return later


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for doc_id, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("gone").to_pylist()):
            words = (text.as_py() or "").encode().split()
            removed = 0
            kept = words
            if gone:
                lost = textkit.runs_to_mask(np.frombuffer(gone, "<u4").astype(np.int64), WINDOW, len(words))
                removed = int(lost.sum())
                kept = list(compress(words, (~lost).tolist()))
            for column, value in zip(rows, (doc_id, len(words), removed, b" ".join(kept).decode())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        sha = pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column("kept_text")], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sha], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _located(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row with ``gone``: packed starts of its windows that a smaller document has."""
    n = tables.partitions(spark)
    keyed, repeats = _distinct(spark, docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-size // BUCKET_BYTES))

    def asked(sent: DataFrame, hash_kind: type, answer, name: str) -> DataFrame:
        met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(hash_kind, buckets, answer), _PACKED)
        told = met.repartition(n, "bucket").sortWithinPartitions("bucket")
        return told.mapInArrow(_each_bucket(_by_document), "key long, at binary").withColumnRenamed("at", name)

    keyed_texts = keyed.select("key", "doc_id", "text")
    anchors = asked(keyed_texts.mapInArrow(_send_blocks(buckets), _PACKED), np.uint32, _anchors, "anchors")
    gone = asked(keyed_texts.join(anchors, "key").mapInArrow(_send_windows(buckets), _PACKED), np.uint64, _repeats, "gone")
    found = keyed.join(gone, "key", "left")
    return (_each_time(spark, found) if repeats else found).select("doc_id", "text", "gone")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the text that is left, its words joined by one space."""
    return _located(spark, docs).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _located(spark, tables.read(spark, sf_dir, "documents"))
    return located.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i)),
m AS (SELECT g, min(doc_id) AS first_doc FROM s GROUP BY g),
c AS (
  SELECT DISTINCT s.doc_id, i + k AS j
  FROM s JOIN m USING (g), unnest(range({WINDOW})) AS u(k) WHERE s.doc_id > m.first_doc),
g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(
    CASE WHEN js IS NULL THEN w
    ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
