"""Reading the input tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a session on one machine (as in tests) gets a temporary one; on
    several machines that would lose tables, so there it is an error.
    """
    conf = spark.sparkContext.getConf()
    known = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="linewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors repeat nothing above it.

    The table goes when the driver ends, since frames may read it until then.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(frame.schema).parquet(path)


def columns(frame: DataFrame) -> list[Column]:
    """All columns by their names, whatever characters those have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in frame.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with at least this part of all rows are hot; there are at most SHARE of them, whatever the size of a table.
SHARE = 1000


def attach(rows: DataFrame, answers: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join rows (``total`` in number) to answers, which hold each key once and in ``_n`` how many of the rows have it.

    The answers to hot keys are broadcast, so no task receives all rows of such a key; all
    other keys meet by a shuffle. how: inner, left or left_semi.
    """
    hot = answers.filter(F.col("_n") * SHARE >= total).drop("_n")
    cold = answers.filter(F.col("_n") * SHARE < total).drop("_n")
    spread = rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    return spread.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))
