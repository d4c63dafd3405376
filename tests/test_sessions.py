import json

from pyspark.sql import functions as F

from linewright.sources import settings, sink


def _texts(spark, folder):
    return spark.read.text(str(folder), wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")


def _session(spark, tmp_path, files):
    (tmp_path / "session").mkdir(exist_ok=True)
    for name, state in files.items():
        (tmp_path / "session" / name).write_text(json.dumps(state))
    rows = settings.read_cache(spark, str(tmp_path / "session"))
    return rows.withColumns({p: F.lit(f"[{p}]") for p in settings.PATTERNS})


def _values(frame):
    return {r["file_name"]: json.loads(r["value"]) for r in frame.collect()}


def test_export_merges_by_file_and_keeps_the_rest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"glossary": "x=1\r\n# note\ny = 2", "filter_text": "r1\nr2\n", "n": 7, "deep": {"k": [1, None]}}))
    (tmp_path / "in/b.json").write_text("broken")
    session = _session(spark, tmp_path, {
        "a.json": {"glossary_text": "y=3\nz=4\nz=5\nmemo", "filter_text": "r2\nr3"}, "b.json": {"glossary_text": "q=1"}, "c.json": {"filter_text": " new "},
    })
    files = _texts(spark, tmp_path / "in")
    got = _values(settings.exported(files, session))
    assert got["a.json"] == {
        "n": 7, "deep": {"k": [1, None]}, "glossary": "x=1\n# note\ny=3\nz=5\nmemo", "filter_text": "r1\nr2\nr3", "glossary_temp": "", **{p: f"[{p}]" for p in settings.PATTERNS},
    }
    assert got["b.json"]["glossary"] == "q=1" and got["c.json"]["filter_text"] == "new" and set(got) == {"a.json", "b.json", "c.json"}
    plain = _values(settings.exported(files, session, merge=False))
    assert plain["a.json"]["glossary"] == "y=3\nz=4\nz=5\nmemo" and plain["a.json"]["n"] == 7
    sink.write(settings.exported(files, session), str(tmp_path / "out"))
    assert _values(_texts(spark, tmp_path / "out")) == got


def test_import_and_the_round_trip_of_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"glossary": "g=1", "base_regex": "x+"}))
    link = {"title": "t", "url": "v", "is_current": False}
    session = _session(spark, tmp_path, {"a.json": {"current_url": "u", "url_related_links": [link], "other": {"z": 1}, "glossary_text": "old=1"}, "b.json": {"glossary_text": "keep=1"}})
    made = settings.imported(session, settings.read_settings(spark, str(tmp_path / "in")))
    rows = {r["file_name"]: r for r in made.collect()}
    assert (rows["a.json"]["glossary_text"], rows["a.json"]["base_regex"]) == ("g=1", "x+")
    assert (rows["b.json"]["glossary_text"], rows["b.json"]["base_regex"]) == ("keep=1", "[base_regex]")
    sink.write(settings.saved_cache(_texts(spark, tmp_path / "session"), made), str(tmp_path / "out"))
    written = json.loads((tmp_path / "out/a.json").read_text())
    assert written["other"] == {"z": 1} and written["url_related_links"] == {"u": [link]} and written["editor_font_size"] == 12
    again = settings.read_cache(spark, str(tmp_path / "out"))
    key = lambda r: r["file_name"]
    assert sorted(again.collect(), key=key) == sorted(made.drop(*settings.PATTERNS).select(*again.columns).collect(), key=key)
