"""Keyed, capped histories and lookups with fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import scalar


def merge(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The newest entry of each key of all parts; of equally new ones that of the last part, then the greatest by its other columns."""
    both = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        both = both.unionByName(part.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_part"]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_part", F.to_json(F.struct(*rest)))).alias("_e"))
    return newest.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest])


def upsert(history: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As ``merge`` of a history and what is fresh."""
    return merge([history, fresh], keys, [order])


def newest(history: DataFrame, most: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The newest entries, of all or of each group."""
    descending = [F.desc(c) for c in order]
    if not by:
        return history.orderBy(*descending).limit(max(1, most))
    ranked = history.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*descending)))
    return ranked.filter(F.col("_n") <= max(1, most)).drop("_n")


def find(history: DataFrame, words: str) -> DataFrame:
    """Entries whose title or url holds the words, in any case."""
    needle = words.lower()
    return history.filter(F.lower("title").contains(needle) | F.lower("url").contains(needle))


def evict(cache: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Cached entries that no history row names any more."""
    return cache.join(history, key, "left_anti")


def originals(files: DataFrame, cache: DataFrame) -> DataFrame:
    """For each (file_name, text) its original: by name, else the earliest with the same fingerprint; equally old ones by text."""
    named = cache.groupBy("file_name").agg(F.max_by("text", F.struct("ts", "text")).alias("by_name"))
    marked = cache.withColumn("author_key", scalar.author_fingerprint(F.col("text"))).filter("author_key IS NOT NULL")
    marked = marked.groupBy("author_key").agg(F.min_by("text", F.struct("ts", "text")).alias("by_key"))
    # Files without a fingerprint, most of them, would all meet in the task of the null key; nothing has the key they get.
    own = F.coalesce(scalar.author_fingerprint(F.col("text")), F.concat(F.lit("\0"), F.coalesce("file_name", F.md5("text"), F.lit(""))))
    rows = files.withColumn("author_key", own)
    joined = rows.join(named, "file_name", "left").join(marked, "author_key", "left")
    return joined.select("file_name", "text", F.coalesce("by_name", "by_key").alias("original"))
