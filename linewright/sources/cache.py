"""Pages kept by url in buckets of their md5; a change rewrites the buckets that it touches and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources import shared


class PageCache:
    """(cache_key, url, html) under a path, one folder for each bucket; for one writer at a time.

    ``buckets`` is fixed for a path; give about one for each 100 MB that the cache will hold.
    A null url or html is not kept. Of rows that share a url the greatest html is kept. A
    change is committed bucket by bucket: should the driver die meanwhile, the pages of a
    bucket may be gone, and are misses then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        keyed = rows.filter("url IS NOT NULL").withColumn("cache_key", F.md5("url"))
        return keyed.withColumn("bucket", self._bucket(F.col("cache_key")))

    def read(self) -> DataFrame:
        """What is kept: (cache_key, url, html, bucket)."""
        schema = "cache_key string, url string, html string, bucket int"
        store, place = shared.store(self.spark, self.path)
        if not store.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The rows (url, ...) with the html that is kept of them, null at a miss, and is_hit."""
        kept = self.read().select(F.col("url").alias("_url"), "html", F.lit(True).alias("is_hit"))
        found = rows.join(kept, F.col("url") == F.col("_url"), "left").drop("_url")
        return found.withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))

    def _rewrite(self, rows: DataFrame) -> None:
        placed = rows.select("cache_key", "url", "html", "bucket").repartition("bucket").sortWithinPartitions("bucket", "cache_key")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of buckets, at most as many as there are."""
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]

    def put(self, pages: DataFrame) -> None:
        """Keep (url, html); a kept page of the same url goes."""
        fresh = self._keyed(pages.filter("html IS NOT NULL").groupBy("url").agg(F.max("html").alias("html")))
        fresh = shared.written(fresh.select("cache_key", "url", "html", "bucket"), "pages-to-cache")
        touched = self._touched(fresh)
        if touched:
            old = self.read().filter(F.col("bucket").isin(touched)).join(fresh, ["bucket", "cache_key"], "left_anti")
            self._rewrite(old.unionByName(fresh))

    def keep_only(self, wanted: DataFrame) -> None:
        """Evict every page whose url is not among the wanted (url)."""
        keys = self._keyed(wanted.select("url")).select("bucket", "cache_key").distinct()
        stale = shared.written(self.read().select("bucket", "cache_key").join(keys, ["bucket", "cache_key"], "left_anti"), "pages-to-evict")
        touched = self._touched(stale)
        if not touched:
            return
        left = self.read().filter(F.col("bucket").isin(touched)).join(stale, ["bucket", "cache_key"], "left_anti")
        filled = set(self._touched(left))
        if filled:
            self._rewrite(left)
        for bucket in set(touched) - filled:  # a bucket that writes no row is not overwritten
            store, place = shared.store(self.spark, f"{self.path}/bucket={bucket}")
            store.delete(place, True)

    def read_through(self, rows: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows (url, ...) with html and is_hit; misses are fetched once for each url, and kept.

        ``fetch`` makes (url, html) of (url); what it gives is written before it is used.
        """
        found = self.lookup(rows)
        missing = found.filter("NOT is_hit AND url IS NOT NULL").select("url").distinct()
        fetched = shared.written(fetch(missing).select("url", "html").groupBy("url").agg(F.max("html").alias("html")), "fetched")
        was_hit = shared.written(found, "looked-up")
        self.put(fetched)
        filled = was_hit.join(fetched.select(F.col("url").alias("_url"), F.col("html").alias("_html")), F.col("url") == F.col("_url"), "left")
        return filled.withColumn("html", F.coalesce("html", "_html")).drop("_url", "_html")
