"""Widths of characters, read from font files, as a table that the layout functions look up.

``read`` gives a row for each character of each font, ``lookup`` one row for each font, and
``attach`` puts it beside the documents that name the font. A lookup has an array of 256
widths for each block of code points in use, so a width is found by two array accesses.

Cases: a file that is no font gives one row with an error and no widths, an empty file none. Characters that a
font lacks have the width of its glyph 0 (code -1). A collection gives one font a face,
``name.ttc#1`` and so on behind the first. Documents with an unknown font get null.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import rx
from linewright.sources import shared

PAGE = 256
#: A lookup has at most 4.5 MB (all 4,352 blocks); so many fonts are broadcast, more are joined by key.
BROADCAST_FONTS = 32
_SCHEMA = "font string, units int, code int, width int, error string"
MISSING = -1


def _tables(data: bytes, at: int) -> dict[str, bytes]:
    found = {}
    for i in range(struct.unpack_from(">H", data, at + 4)[0]):
        tag, _, start, size = struct.unpack_from(">4sIII", data, at + 12 + 16 * i)
        found[tag.decode("latin-1")] = data[start : start + size]
    return found


def _segments(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points and glyphs of a table of segments (format 4)."""
    n = struct.unpack_from(">H", table, 6)[0] // 2
    ends, starts, deltas, ranges = (np.frombuffer(table, ">u2", n, 14 + 2 * n * k + (2 if k else 0)).astype(np.int64) for k in range(4))
    words = np.frombuffer(table, ">u2", (len(table) - 16 - 6 * n) // 2, 16 + 6 * n).astype(np.int64)
    codes, glyphs = [], []
    for i in range(n):
        code = np.arange(starts[i], ends[i] + 1)
        if ranges[i]:
            at = i + ranges[i] // 2 + code - starts[i]
            inside = at < len(words)
            raw = np.where(inside, words[np.minimum(at, len(words) - 1)], 0)
            glyph = np.where(raw > 0, (raw + deltas[i]) % 65536, 0)
        else:
            glyph = (code + deltas[i]) % 65536
        codes.append(code)
        glyphs.append(glyph)
    return np.concatenate(codes), np.concatenate(glyphs)


def _groups(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points and glyphs of a table of groups (format 12)."""
    n = struct.unpack_from(">I", table, 12)[0]
    rows = np.frombuffer(table, ">u4", 3 * n, 16).reshape(n, 3).astype(np.int64)
    rows = rows[(rows[:, 0] <= rows[:, 1]) & (rows[:, 1] <= 0x10FFFF)]
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([np.arange(a, b + 1) for a, b, _ in rows])
    return codes, codes + np.repeat(rows[:, 2] - rows[:, 0], rows[:, 1] - rows[:, 0] + 1)


def widths(data: bytes, at: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Units of an em, code points and widths of the face that begins at a place of a file; code -1 is glyph 0."""
    tables = _tables(data, at)
    units = struct.unpack_from(">H", tables["head"], 18)[0]
    n = struct.unpack_from(">H", tables["hhea"], 34)[0]
    advances = np.frombuffer(tables["hmtx"], ">u2", 2 * n)[::2].astype(np.int64)
    cmap = tables["cmap"]
    best: tuple[int, int] | None = None
    for i in range(struct.unpack_from(">H", cmap, 2)[0]):
        platform, encoding, start = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        kind = struct.unpack_from(">H", cmap, start)[0]
        if kind in (4, 12) and (platform == 0 or platform == 3 and encoding in (1, 10)):
            best = max(best or (0, 0), (kind, start))
    if best is None:
        raise ValueError("no table of Unicode characters")
    part = cmap[best[1] :]
    if best[0] == 4:
        codes, glyphs = _segments(part[: struct.unpack_from(">H", part, 2)[0] or len(part)])
    else:
        codes, glyphs = _groups(part)
    codes, glyphs = codes[glyphs > 0], glyphs[glyphs > 0]
    codes, first = np.unique(codes, return_index=True)
    own = advances[np.minimum(glyphs[first], n - 1)]  # all glyphs behind the last have its width
    return units, np.append(codes, MISSING), np.append(own, advances[0])


def faces(data: bytes) -> list[int]:
    """Where the faces of a file begin."""
    if data[:4] != b"ttcf":
        return [0]
    return list(struct.unpack_from(f">{struct.unpack_from('>I', data, 8)[0]}I", data, 12))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(font, units, code, width, error): the widths in the fonts of a folder; a font is named by its file."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, data = os.path.basename(name), content.as_py()
                try:
                    found = [widths(data, at) for at in faces(data)]
                except (struct.error, KeyError, ValueError, IndexError) as broken:
                    yield pa.RecordBatch.from_pylist([{"font": base, "error": f"{type(broken).__name__}: {broken}"}], kind)
                    continue
                for i, (units, codes, own) in enumerate(found):
                    n = len(codes)
                    constant = ([f"{base}#{i}" if i else base] * n, [units] * n)
                    columns = [*constant, codes.astype(np.int32), own.astype(np.int32), [None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    kind = pa.schema([("font", pa.string()), ("units", pa.int32()), ("code", pa.int32()), ("width", pa.int32()), ("error", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttf,otf,ttc,TTF,OTF,TTC}").load(path)
    return files.select(F.col("_metadata.file_name"), "content").mapInArrow(each, _SCHEMA)


def _dense(entries: Column, last: Column) -> Column:
    """An array with each (place, value) at its place, null elsewhere, up to the last place."""
    return rx.let(F.map_from_entries(entries), lambda placed: F.transform(F.sequence(F.lit(0), last), lambda i: F.try_element_at(placed, i)))


def lookup(metrics: DataFrame) -> DataFrame:
    """(font, widths) from rows of (font, code, width); of repeated codes the widest counts."""
    known = metrics.filter("font IS NOT NULL AND code IS NOT NULL AND width IS NOT NULL").groupBy("font", "code").agg(F.max("width").cast("int").alias("width"))
    page = F.floor(F.col("code") / PAGE).cast("int").alias("page")
    placed = known.filter(F.col("code") >= 0).select("font", page, F.pmod("code", F.lit(PAGE)).alias("slot"), "width")
    pages = placed.groupBy("font", "page").agg(_dense(F.collect_list(F.struct("slot", "width")), F.lit(PAGE - 1)).alias("own"))
    pages = pages.groupBy("font").agg(_dense(F.collect_list(F.struct("page", "own")), F.max("page")).alias("pages"))
    missing = known.filter(F.col("code") == MISSING).select("font", F.col("width").alias("missing"))
    both = pages.join(missing, "font", "full")
    empty = F.array().cast("array<array<int>>")
    return both.select("font", F.struct(F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("pages", empty).alias("pages")).alias("widths"))


def attach(docs: DataFrame, found: DataFrame, font: str = "font") -> DataFrame:
    """Documents with the ``widths`` of the font that a column names, null where it is unknown; the lookup is written first, once."""
    found = shared.written(found, "fonts")
    named = found.select(F.col("font").alias(font), "widths")
    few = found.limit(BROADCAST_FONTS + 1).count() <= BROADCAST_FONTS
    return docs.join(F.broadcast(named) if few else named, font, "left")
