"""Best-fit packing of documents into training sequences.

Tokenising is a narrow Arrow stage that keeps a few numbers for each piece, in a table of
the shared folder. Pieces that fill a sequence are sequences of their own there. The
others are dealt by their row number to lanes, where they arrive in order; each lane is an
online best-fit over ``OPEN_BINS`` open bins: a bitset has one bit for each amount of free
space that some open bin has, so the tightest bin that still fits is the lowest set bit
at or above the piece's length. Where too many bins are open, the fullest closes. A lane
looks ahead ``AHEAD`` pieces and places them so that complements meet (one that leaves r
free just before those of length r, from the middle down), so few bins stay open long.

Lanes grow in number with the table, never in size, so no task sees more than
``LANE_PIECES`` pieces (in expectation); they follow the partitions of a shuffle where
there are fewer pieces, but hold ``LEAST_PIECES`` as each leaves some sequences unfilled.
A task that runs again reads the same table and packs alike.

Cases: a null or empty text is one piece that holds the end id alone. Repeated rows
are packed as often as they occur. An empty table gives no rows. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import encoding, tables

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1024
AHEAD = 8192
LANE_PIECES = 1 << 18
LEAST_PIECES = 1 << 14

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


class OpenBins:
    """A bounded set of open bins, found by free space through a bitset."""

    def __init__(self, most: int):
        self.most = most
        self.count = 0
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}

    def _put(self, free: int, sequence: int) -> None:
        self.by_free.setdefault(free, []).append(sequence)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        sequence = same.pop()
        if not same:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence

    def place(self, length: int, capacity: int, fresh: int) -> tuple[int, int, bool]:
        """The sequence and offset for a piece, and whether the sequence is the fresh one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence, new = self._take(free), False
        else:
            free, sequence, new = capacity, fresh, True
        if free > length:
            if self.count >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest <= free - length:
                    self._take(fullest)
                else:  # the bin at hand is the fullest, so it closes
                    return sequence, capacity - free, new
            self._put(free - length, sequence)
        return sequence, capacity - free, new


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: whole ones, but for the first of a longer text."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids and the number of the row."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoding.encoder(path)
        row_no = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            n = len(rows[0])
            columns = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(row_no, row_no + n))], ["doc_id", "piece", "start", "length", "ids_crc32", "row_no"])
            row_no += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, f"{_PIECES}, row_no long")


def _placing(capacity: int, open_bins: int, ahead: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fresh = TaskContext.get().partitionId() << 40
        bins = OpenBins(open_bins)

        def settle(held: pa.Table) -> pa.RecordBatch:
            nonlocal fresh
            lengths = held.column("length").to_numpy()
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            left = np.minimum(lengths, capacity - lengths)
            for i in np.lexsort((-lengths, -left)).tolist():
                sequences[i], offsets[i], new = bins.place(int(lengths[i]), capacity, fresh)
                fresh += new
            columns = [held.column(c).combine_chunks() for c in held.schema.names if c != "row_no"]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sequences), pa.array(offsets)], [f.split()[0] for f in _PLACED.split(", ")])

        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= ahead:
                table = pa.Table.from_batches(held)
                yield settle(table.slice(0, ahead))
                held = table.slice(ahead).to_batches()
                waiting -= ahead
        if waiting:
            yield settle(pa.Table.from_batches(held))

    return place


def pack(made: DataFrame, lanes: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, ahead: int = AHEAD) -> DataFrame:
    """Give each piece a sequence and an offset in it; full ones are numbered below zero."""
    full = made.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row_no")).withColumn("offset", F.lit(0).cast("long")).drop("row_no")
    lane = made.filter(F.col("length") != capacity).repartition(lanes, "row_no").sortWithinPartitions("row_no")
    return lane.mapInArrow(_placing(capacity, open_bins, ahead), _PLACED).unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, lane_pieces: int = LANE_PIECES) -> DataFrame:
    spark = docs.sparkSession
    made = tables.cut(spark, pieces(docs, path or encoding.default_path(), capacity), "pieces")
    n = made.filter(F.col("length") != capacity).count()
    lanes = max(1, -(-n // lane_pieces), min(tables.partitions(spark), n // LEAST_PIECES))
    return pack(made, lanes, capacity, open_bins)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(tables.read(spark, sf_dir, "documents"))
