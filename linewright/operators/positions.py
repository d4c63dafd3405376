"""Joins by position: tables of places in documents with fragments, lines and originals.

A document may hold a large part of all lines, so nothing here brings a whole document
into one task: lines meet by document and block of ``BLOCK`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.operators import lines as L

BLOCK = 256


def _block(line: Column) -> Column:
    return F.floor(line / BLOCK)


def next_fragments(positions: DataFrame, found: DataFrame, key: str = "doc_id", line: str = "line_no") -> DataFrame:
    """Each row of positions with the first fragment at or below its line, by seq: its frag_id, seq and line (frag_line), null without one.

    positions: (key, line) and any other columns; found: (key, line, seq, frag_id). A
    forward as-of join: both tables are sorted together within blocks, and a block hands
    its first fragment to those above it. Rows with a null key or line find none.
    """
    frag = F.struct(F.col("seq").alias("seq"), F.col("frag_id").alias("frag_id"), F.col(line).alias("frag_line"))
    row = F.struct(*(F.col(f"`{c}`") for c in positions.columns))
    kind = found.select(frag.alias("f")).schema["f"].dataType
    place = positions.schema
    left = positions.select(F.col(key).alias("_key"), F.col(line).cast("long").alias("_line"), F.lit(1).alias("_part"), row.alias("_row"), F.lit(None).cast(kind).alias("_frag"))
    right = found.select(F.col(key).alias("_key"), F.col(line).cast("long").alias("_line"), F.lit(0).alias("_part"), F.lit(None).cast(place).alias("_row"), frag.alias("_frag"))
    both = left.unionByName(right).withColumn("_block", _block(F.col("_line")))
    below = Window.partitionBy("_key", "_block").orderBy(F.desc("_line"), "_part").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_key").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("_key", "_block").agg(F.min("_frag").alias("_first")).withColumn("_later", F.min("_first").over(later)).drop("_first")
    near = both.withColumn("_frag", F.min("_frag").over(below)).filter("_part = 1").join(blocks.filter("_later IS NOT NULL"), ["_key", "_block"], "left")
    nearest = F.when(F.col("_key").isNotNull() & F.col("_line").isNotNull(), F.least("_frag", "_later"))
    return near.withColumn("_frag", nearest).select("_row.*", "_frag.frag_id", "_frag.seq", "_frag.frag_line")


def spans(originals: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each row of places with the original's text from (first_line, first_col) to (last_line, last_col), from 0, clamped.

    A line beyond the end counts as the last one, a column beyond its end as the end; where
    the end does not lie behind the start the text is empty. Rows without an original are
    left out. A range join: places meet the lines of the blocks that they run over.
    """
    held = L.to_lines(originals, key).withColumn("_at", F.col("line_no") - 1).withColumn("_block", _block(F.col("_at")))
    sizes = originals.filter(F.col("text").isNotNull()).select(key, F.size(L.split_lines(F.col("text"))).alias("_n"))
    clamp = lambda c: F.least(F.col(c), F.col("_n") - 1).cast("long")
    rows = places.withColumn("_id", F.struct(*(F.col(f"`{c}`") for c in places.columns))).groupBy(key, "_id").agg(F.count("*").alias("_times"))
    rows = rows.join(sizes, key).select(key, "_id", "_times", *(F.col(f"_id.{c}").alias(c) for c in ("first_line", "first_col", "last_line", "last_col")), "_n")
    rows = rows.withColumns({"first_line": clamp("first_line"), "last_line": clamp("last_line")})
    met = rows.filter(F.col("first_line") <= F.col("last_line")).withColumn("_block", F.explode(F.sequence(_block(F.col("first_line")), _block(F.col("last_line")))))
    met = met.join(held, [key, "_block"]).filter(F.col("_at").between(F.col("first_line"), F.col("last_line")))
    start = F.when(F.col("_at") == F.col("first_line"), F.least("first_col", F.length("line"))).otherwise(0)
    end = F.when(F.col("_at") == F.col("last_line"), F.least("last_col", F.length("line"))).otherwise(F.length("line"))
    piece = F.substring("line", (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p")))), lambda x: x["p"]), "\n")
    made = met.groupBy(key, "_id").agg(whole.alias("_text"))
    out = rows.select(key, "_id", "_times").join(made, [key, "_id"], "left")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_id.*", F.coalesce("_text", F.lit("")).alias("text"))


def restore_from(texts: DataFrame, originals: DataFrame, tops: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, top, text): for each row (key, top) the old lines above top (from 0, clamped to both texts) and the new ones from there on."""
    joined = tops.select(key, "top").join(texts.select(key, F.col("text").alias("_old")), key).join(originals.select(key, F.col("text").alias("_new")), key)
    old, new = L.split_lines(F.col("_old")), L.split_lines(F.col("_new"))
    at = F.greatest(F.least(F.col("top"), F.size(old), F.size(new)), F.lit(0)).cast("int")
    merged = F.concat(F.slice(old, F.lit(1), at), F.slice(new, at + 1, F.greatest(F.size(new) - at, F.lit(0))))
    return joined.select(key, "top", F.array_join(merged, "\n").alias("text"))
