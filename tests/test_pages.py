"""Fixtures for pages, names, frames, histories, sources and streams."""

from pyspark.sql import functions as F

from linewright.operators import history, layout, names, pages
from linewright.sources import html, settings
from linewright.streaming.history import HistorySink


def test_posts_and_layouts(spark):
    body = '<div class="article"><dl><dt>1 名前：A[] </dt><dd>\nx<br>y<br> <br></dd><dt>2 名前：B[] d</dt><dd>z</dd></dl></div><dl class="relate_dl"><li class="relate_li"><a href="/3">3話</a></li><li class="relate_li_nolink">2話</li><li class="relate_li"><a href="/1">1話</a></li></dl>'
    frame = spark.createDataFrame([(1, "https://s.example/2", body), (2, "https://s.example/x", "<p>none</p>")], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.parse(frame).collect()}
    assert got[1]["text"] == "1 名前：A[]\n\nx\ny\n\n2 名前：B[] d\nz" and got[1]["site"] == "default" and got[2]["text"] is None
    only = {r["page_id"]: r["text"] for r in pages.parse(frame, author_only=True, sites=pages.SITES[:1]).collect()}
    assert only[1] == "1 名前：A[]\n\nx\ny"
    nav = pages.navigation(frame)
    assert [(r["url"], r["is_current"]) for r in nav.filter("page_id = 1").orderBy("pos").collect()] == [("https://s.example/1", False), (None, True), ("https://s.example/3", False)]
    beside = pages.adjacent(nav).first()
    assert (beside["previous"], beside["next"]) == ("https://s.example/1", "https://s.example/3")


def test_author_blocks(spark):
    text = ["序", "1 名前：A[] d", "x", "2 名前：B[] d", "y", "3 名前：A.[] d", '<span style="color:red">z</span>']
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "page_id int, line_no int, line string")
    assert [r["line"] for r in pages.author_blocks(rows, "A", author_only=True).orderBy("line_no").collect()] == [text[1], "x", text[5], text[6]]
    assert pages.first_poster(rows).first()["author"] == "A"


def test_names(spark):
    page = '<dl><dt>萊莎琳（<span lang="ja">ライザリン</span>）</dt></dl><table class="wikitable"><tr><td>ミナ</td><td>米娜</td></tr></table>'
    rows = names.pairs(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert sorted((r["jp"], r["cn"]) for r in rows.collect()) == [("ミナ", "米娜"), ("ライザリン", "萊莎琳")]
    assert names.as_glossary(rows).first()["text"] == "ライザリン=萊莎琳\nミナ=米娜"


def test_frames(spark):
    docs = spark.createDataFrame([(1, "前\n┌──┐\n│あ│\n└──┘\n後"), (2, "x"), (3, "┌──┐\n┌──┐\n│a│\n└──┘")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in layout.adjust(docs).collect()}
    assert got[1]["text"] == "前\n┌───┐\n│あ　　│\n└───┘\n後" and got[1]["n_boxes"] == 1
    assert got[2]["text"] == "x" and got[3]["n_boxes"] == 1


def test_histories(spark):
    rows = spark.createDataFrame([(0, "u1", "a"), (1, "u2", "b"), (2, "u1", "c")], "seq int, url string, title string")
    kept = history.newest(history.upsert(rows.filter("seq < 2"), rows.filter("seq = 2"), ["url"], "seq"), 2, ["seq"])
    assert [r["url"] for r in kept.orderBy("seq").collect()] == ["u2", "u1"]
    stamp = "1 ： N ： 2023/04/02(日) 20:54:38.52 ID:5UkYdPSV"
    cache = spark.createDataFrame([("a.html", stamp + "\nold", 1.0)], "file_name string, text string, ts double")
    files = spark.createDataFrame([("renamed.html", stamp), ("a.html", "x"), ("c.html", "y")], "file_name string, text string")
    assert {r["file_name"]: r["original"] for r in history.originals(files, cache).collect()} == {"renamed.html": stamp + "\nold", "a.html": stamp + "\nold", "c.html": None}


def test_html_round_trip(spark, tmp_path):
    text = 'a<b <span style="color:red">x</span>'
    frame = spark.createDataFrame([("p.html", text)], "file_name string, text string")
    whole = frame.select("file_name", html.page(F.col("text"), F.lit("#fff")).alias("value"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.HTML").write_text(whole.first()["value"], encoding="utf-8")
    (tmp_path / "in" / "q.txt").write_text("no")
    back = html.read_folder(spark, str(tmp_path / "in")).select("file_name", html.pre_text(F.col("value")).alias("t"), html.background(F.col("value")).alias("c")).collect()
    assert [(r["file_name"], r["t"], r["c"]) for r in back] == [("p.HTML", text, "#fff")]
    assert "<pre>a&lt;b <span" in whole.first()["value"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, event_id long, value double"
    rows = [(i % 5, i, float(i)) for i in range(40)]
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = HistorySink(spark, str(tmp_path / "out"), ["user_id"], ["event_id"], most=3)
    sink.start(stream, str(tmp_path / "log")).awaitTermination(120)
    last = sink.latest(spark.createDataFrame([], schema).schema)
    expected = history.newest(history.upsert(spark.createDataFrame([], schema), spark.createDataFrame(rows, schema), ["user_id"], "event_id"), 3, ["event_id"])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.select(*last.columns).collect()))


def test_a_stream_without_its_checkpoint_goes_on(spark, tmp_path):
    schema = "user_id long, event_id long, title string"
    sink = HistorySink(spark, str(tmp_path / "out"), ["user_id"], ["event_id"])
    rows = [(1, 1, "a"), (2, 2, "b"), (1, 3, "c"), (3, 4, "d")]
    for k, row in enumerate(rows):
        sink.write(spark.createDataFrame([row], schema), k)
    kept = {(1, 3, "c"), (2, 2, "b"), (3, 4, "d")}
    assert sink.tiers() == [(0, 3)] and set(map(tuple, sink.latest(schema).collect())) == kept
    (tmp_path / "out/tier=4-4").mkdir()  # a tier that was never finished
    again = HistorySink(spark, str(tmp_path / "out"), ["user_id"], ["event_id"])
    again.write(spark.createDataFrame(rows[:1], schema), 0)
    again.write(spark.createDataFrame(rows[3:], schema), 1)
    again.write(spark.createDataFrame(rows[3:], schema), 1)
    assert set(map(tuple, again.latest(schema).collect())) == kept and again.tiers() == [(0, 3), (4, 5), (6, 6)]


def test_tiers_rewrite_little_and_cap_exactly(spark, tmp_path):
    schema = "k long, ts long, tie long, v string"
    rows = [((7 * i) % 13, i // 3, i % 3, f"v{i}") for i in range(66)]
    sink = HistorySink(spark, str(tmp_path / "out"), ["k"], ["ts", "tie"], most=5)
    oldest = None
    for k in range(11):
        sink.write(spark.createDataFrame(rows[6 * k : 6 * k + 6], schema), k)
        best = {}
        for row in rows[: 6 * k + 6]:
            best[row[0]] = max(best.get(row[0], row), row, key=lambda r: (r[1], r[2]))
        expected = set(sorted(best.values(), key=lambda r: (r[1], r[2], r[0]))[-5:])
        assert set(map(tuple, sink.latest(schema).collect())) == expected
        if k == 7:
            oldest = {f.name for f in (tmp_path / "out/tier=0-7").iterdir()}
    assert sink.tiers() == [(0, 7), (8, 9), (10, 10)]
    assert {f.name for f in (tmp_path / "out/tier=0-7").iterdir()} == oldest


def test_originals_of_equal_age(spark):
    cache = spark.createDataFrame([("f", "x", 1.0), ("f", "y", 1.0)], "file_name string, text string, ts double")
    files = spark.createDataFrame([("f", "z")], "file_name string, text string")
    assert [r["original"] for r in history.originals(files, cache.repartition(2, "text")).collect()] == ["y"]


def test_settings_and_caches(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"base_regex": "x", "other": 1}')
    (tmp_path / "b.json").write_text("broken")
    rows = {r["file_name"]: r for r in settings.read_settings(spark, str(tmp_path)).collect()}
    assert rows["a.json"]["base_regex"] == "x" and rows["b.json"]["base_regex"] == settings.SETTINGS["base_regex"] and rows["a.json"]["glossary"] == ""
    raw = settings._raw(spark, str(tmp_path)).filter("file_name = 'a.json'")
    fresh = raw.select("file_name", *[F.lit(p).alias(p) for p in settings.PATTERNS])
    assert settings.with_patterns(raw, fresh).first()["raw"] == {"other": "1", **{p: p for p in settings.PATTERNS}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/old.json").write_text('{"current_url": "u", "url_related_links": [{"title": "t", "url": "v", "is_current": false}], "fetch_history_limit": "7", "editor_font_size": "x", "source_text": "a\\n\\n", "auto_copy": true}')
    (tmp_path / "c/new.json").write_text('{"url_related_links": {"w": []}, "url_history": [{"url": "u", "title": "t"}]}')
    got = {r["file_name"]: r for r in settings.read_cache(spark, str(tmp_path / "c")).collect()}
    old, new = got["old.json"], got["new.json"]
    assert old["original_cache_limit"] == 7 and old["editor_font_size"] == 12 and old["source_text"] == "a" and old["auto_copy"] is True
    assert list(old["url_related_links"]) == ["u"] and old["url_related_links"]["u"][0]["url"] == "v"
    assert new["url_related_links"] == {"w": []} and new["url_history"][0]["url"] == "u" and new["doc_num"] == "1"


def test_marked_lists_and_flat_pages(spark):
    lists = '<ul class="relatedPostsWrap relatedPostsPrev"><li class="x"><a href="/2">2話</a></li><li><a href="/1">1話</a></li></ul><ul class="relatedPostsWrap relatedPostsNext"><li class="currentPost">3話</li><li><a href="/4">4話</a></li></ul>'
    page = f'<title>題 | やる夫ブック</title><div id="entry-content"><dl><dt>1 &#65306; A &#65306; 2021/05/06(木) x</dt><dd>本文</dd></dl></div>{lists}'
    flat = '<div id="entry-content"><button>b</button>1 ： A ： 2021/05/06(木) x<br>\n本文<br></div><div id="comments">c</div>'
    frame = spark.createDataFrame([(1, "https://yaruobook.net/3", page), (2, "https://yaruo-matome.com/1", flat)], "page_id int, url string, html string")
    got = {r["page_id"]: (r["site"], r["text"]) for r in pages.parse(frame).collect()}
    assert got[1] == ("entry", "1 ： A ： 2021/05/06(木) x\n本文")
    assert got[2] == ("matome", "1 ： A ： 2021/05/06(木) x\n本文")
    site = next(s for s in pages.SITES if s.name == "entry")
    nav = pages.navigation(frame, site).filter("page_id = 1").orderBy("pos").collect()
    assert [(r["title"], r["is_current"]) for r in nav] == [("1話", False), ("2話", False), ("3話", True), ("4話", False)]
    assert pages.title(frame, site).filter("page_id = 1").first()["title"] == "題"


def test_frame_kinds_and_nested_blocks(spark):
    text = "､_人人人_\nx\n⌒Y⌒Y⌒Y\n＼─|──|──|─／\n┌─┐\n／─|──|──|─＼\n┌─┐\n└─┘"
    row = spark.createDataFrame([(text,)], "t string").select(layout.boxes(F.split("t", "\n")).alias("b")).first()
    assert [tuple(b) for b in row["b"]] == [(0, 2, "shout"), (3, 5, "slash"), (6, 7, "box")]
    page = 'a<div class="r">x<div>y</div><div\nid=1>z</div>w</div>v</div>'
    got = spark.createDataFrame([(page,), ("none",), ('<div class="r">open',)], "t string").select(pages.balanced_block(F.col("t"), '<div class="r">').alias("b")).collect()
    assert [r["b"] for r in got] == ["x<div>y</div><div\nid=1>z</div>w", "", ""]
    from linewright.operators import lines

    old = spark.createDataFrame([(1, "abc\ndef\ngh")], "doc_id int, text string")
    assert lines.restore_range(old, old, (0, 1), (1, 2)).first()["text"] == "bc\nde"
    assert lines.restore_range(old, old, (1, 9), (9, 9)).first()["text"] == "\ngh"


def test_result(spark):
    post = "<dl><dt>1 名前：A[] </dt><dd>x</dd></dl>"
    listed = '<dt id="1">1 名前：A[] </dt><dd>y</dd><div class="related-entries"><div>newest</div><a href="/2">2話</a><br>1話<br></div>'
    nested = listed.replace('<div>newest</div>', '<div><div>n</div></div><br>')
    rows = [(1, "https://s.example/a", f'<title>T</title><div class="article">{post}</div>'), (2, "https://himanatokiniyaruo.com/3", nested), (3, "u", "<p>no</p>")]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.result(frame).collect()}
    assert (got[1]["site"], got[1]["title"], got[1]["text"], got[1]["status"], got[1]["links"]) == ("default", "T", "T\n\n1 名前：A[]\nx", "text", None)
    assert [(r["title"], r["url"], r["is_current"]) for r in got[2]["links"]] == [("1話", None, True), ("2話", "https://himanatokiniyaruo.com/2", False), ("n", None, True)]
    assert (got[3]["text"], got[3]["status"]) == (None, "none")
    only = {r["page_id"]: (r["text"], r["status"]) for r in pages.result(frame, "B", author_only=True).collect()}
    assert only[1] == (None, "author") and only[3] == (None, "none")


def test_names_written_as_references(spark):
    rows = [(1, "<dl><dt>&#33802;（<span lang='x' lang=\"ja\">&#12521;&#12452;&#12470;</span>）</dt></dl>"), (2, '<table class="wikitable"><tr><td>&#12521;&amp;&lt;</td><td>&#33802;</td></tr></table>')]
    got = {r["page_id"]: (r["jp"], r["cn"]) for r in names.pairs(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {1: ("ライザ", chr(33802)), 2: ("ラ&<", chr(33802))}
