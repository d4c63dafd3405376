from pyspark.sql import functions as F

from linewright.operators import history


def test_files_without_a_fingerprint_do_not_meet_in_one_task(spark):
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        files = spark.createDataFrame([(f"f{i}", "plain") for i in range(200)] + [(None, "plain"), (None, None)], "file_name string, text string")
        cache = spark.createDataFrame([("f1", "old", 1.0), ("x", "2021/05/06(木) 23:19:36 ID:abc", 2.0)], "file_name string, text string, ts double")
        made = history.originals(files, cache)
        assert len(made.groupBy(F.spark_partition_id()).count().collect()) > 1
        assert made.count() == 202 and [r["file_name"] for r in made.filter("original IS NOT NULL").collect()] == ["f1"]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
