from linewright.functions import arrow


def test_only_texts_with_references_go_through_python(spark):
    rows = spark.createDataFrame([("a &amp; b",), ("plain",), (None,), ("",), ("&lt",)], "t string")
    made = rows.select(arrow.unescape_html("t").alias("t"))
    assert [r[0] for r in made.collect()] == ["a & b", "plain", None, "", "<"]
    assert "&" in made._jdf.queryExecution().optimizedPlan().toString()
