"""A history kept by a stream: the newest entry per key, capped, at a cost that follows the batches.

The history lies in tiers. A batch is merged with the newest tiers as long as those hold as
many batches as it then does, like a carry of binary numbers: an entry is rewritten about
log2(n) times in n batches, and a reader merges at most about log2(n) tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linewright.operators import history
from linewright.sources import shared

Tier = tuple[int, int]  # the first and the last batch that it holds


class HistorySink:
    """Tiers of a history under a path, one folder ``tier=<first>-<last>`` for each.

    Batches are counted by the sink itself: merging one once more changes nothing, and a
    stream that lost its checkpoint goes on from what is there. A tier that a later one
    holds stays for readers until the next batch. ``order`` decides which entry of a key is
    the newest. With ``most`` each tier keeps its newest entries only, which is exact: an
    entry among the newest of all is among the newest of its tier.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], most: int | None = None):
        self.spark, self.path, self.keys, self.order, self.most = spark, path.rstrip("/"), keys, order, most

    def _folder(self, tier: Tier) -> str:
        return f"{self.path}/tier={tier[0]}-{tier[1]}"

    def _whole(self) -> list[Tier]:
        """All tiers with Spark's mark of success; a folder without it is none."""
        store, _ = shared.store(self.spark, self.path)
        found = store.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tier=*/_SUCCESS")) or []
        names = [f.getPath().getParent().getName().removeprefix("tier=").split("-") for f in found]
        return sorted((int(first), int(last)) for first, last in names)

    def tiers(self) -> list[Tier]:
        """The tiers that make up the history, oldest first."""
        whole = self._whole()
        return [t for t in whole if not any(o != t and o[0] <= t[0] and t[1] <= o[1] for o in whole)]

    def _read(self, tiers: list[Tier], schema) -> list[DataFrame]:
        return [self.spark.read.schema(schema).parquet(self._folder(t)) for t in tiers]

    def _capped(self, rows: DataFrame) -> DataFrame:
        return history.newest(rows, self.most, [*self.order, *self.keys]) if self.most else rows

    def latest(self, schema) -> DataFrame:
        parts = self._read(self.tiers(), schema) or [self.spark.createDataFrame([], schema)]
        return self._capped(history.merge(parts, self.keys, self.order)).select(*parts[0].columns)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        whole, tiers = self._whole(), self.tiers()
        last = tiers[-1][1] + 1 if tiers else 0
        first, carried = last, []
        while tiers and tiers[-1][1] - tiers[-1][0] == last - first:
            carried.insert(0, tiers.pop())
            first = carried[0][0]
        merged = history.merge([*self._read(carried, batch.schema), batch], self.keys, self.order)
        self._capped(merged).select(*batch.columns).write.mode("overwrite").parquet(self._folder((first, last)))
        for old in set(whole) - {*tiers, *carried}:
            store, place = shared.store(self.spark, self._folder(old))
            store.delete(place, True)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
