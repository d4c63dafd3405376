import pytest
from pyspark.sql import functions as F

from linewright.sources import html


def _frame(spark, rows):
    return spark.createDataFrame(rows, "file_name string, value string")


def _names(folder):
    return sorted(f.name for f in folder.iterdir() if not f.name.endswith(".crc")) if folder.exists() else []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    rows = _frame(spark, [(f"f{i}", str(i)) for i in range(30)])
    bad = rows.withColumn("value", F.when(F.col("file_name") == "f7", F.raise_error("broken")).otherwise(F.col("value")))
    for broken in (bad, rows.union(_frame(spark, [("a/b", "x")]))):
        with pytest.raises(Exception):
            html.write_folder(broken, str(out))
        assert _names(out) == []
    html.write_folder(rows, str(out))
    assert _names(out) == sorted(f"f{i}.html" for i in range(30))
    assert {r["file_name"]: r["value"] for r in html.read_folder(spark, str(out)).collect()} == {f"f{i}.html": str(i) for i in range(30)}


def test_names_that_are_there(spark, tmp_path):
    out = tmp_path / "out"
    html.write_folder(_frame(spark, [("a", "1"), ("b", "2"), (None, "x"), ("c", None)]), str(out))
    with pytest.raises(Exception, match="b.html"):
        html.write_folder(_frame(spark, [("b", "9"), ("d", "4")]), str(out), existing="error")
    assert _names(out) == ["a.html", "b.html"]
    html.write_folder(_frame(spark, [("b", "9"), ("d", "4")]), str(out), existing="keep")
    assert [(out / n).read_text() for n in _names(out)] == ["1", "2", "4"]
    html.write_folder(_frame(spark, [("b", "9"), ("d", "5")]), str(out))
    assert [(out / n).read_text() for n in _names(out)] == ["1", "9", "5"]
    with pytest.raises(Exception):
        html.write_folder(_frame(spark, [("b", "9")]), str(out), existing="perhaps")
    html.write_folder(_frame(spark, []), str(tmp_path / "none"))
    assert _names(tmp_path / "none") == []


def test_fonts_are_embedded_as_pages_are_written(spark, tmp_path):
    (tmp_path / "x.OTF").write_bytes(b"\x00font")
    rows = _frame(spark, [("a", 'say /*"font"*/')])
    made = rows.select("file_name", html.page(F.col("value"), F.lit("#fff"), F.lit("<head></head>"), "Mono").alias("value"))
    html.write_folder(made, str(tmp_path / "out"), font=str(tmp_path / "x.OTF"), family="Mono")
    text = (tmp_path / "out/a.html").read_text()
    rule = html.font_face(spark, str(tmp_path / "x.OTF"), "Mono").first()["css"]
    assert rule in text and text.count("@font-face") == 1 and "'Mono', 'MS PGothic'" in text and "say /*&quot;font&quot;*/" in text
