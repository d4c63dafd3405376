"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder for a session on one machine that has none."""
    conf = spark.sparkContext.getConf()
    known = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linewright-"))
    return spark.conf.get("spark.checkpoint.dir")


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own, which goes with all below it when the driver ends."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    files, place = store(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table of its own, which goes when the driver ends."""
    spark = frame.sparkSession
    path = fresh(spark, label)
    frame.write.mode("append").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, label: str, by: str = "doc_id") -> DataFrame:
    """As ``written``, in as many buckets of ``by`` as shuffles have partitions, so that what is joined or grouped by it is not shuffled again."""
    spark = frame.sparkSession
    path, name = fresh(spark, label), f"{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.bucketBy(n, by).option("path", path).saveAsTable(name)
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay until the driver ends, and the frame knows them
    return made.select(*frame.columns)
