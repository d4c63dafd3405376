"""q_page_text against its SQL on references that the tables hold rarely."""

import duckdb

from linewright.operators import pages
from linewright.plans import catalogue

BODIES = (
    '<h1>a token = &quot</h1><p>a token = &quot;9c&quot; b</p>',  # a title cut within a reference
    "<h1>que &</h1><p>para</p> <h1>a &am</h1><p>p b</p> &lt&gt &#x27 &amp",
    "&copy; &nbsp;x &#39; &middot; &eacute; &lt;b&gt; &#x27;",
    "&amp;quot; &amp;amp; &ampquot; &amp;lt",
    "<p>&nbsp;</p>",
    "<br> <br>\n a<br>b \n\n<br>",
    " \n",
    "<br>\u3000<br>x<br>\u00a0",  # white space is that of ASCII
    "\u00a0",
    "a&lt;/span&gt;b &lt;span style=\"color:red\"&gt;",  # what is escaped is no tag
    'a<span style="color:red" class="x">b</span> <font color="blue">c</font><span style="color:#000">d</span>',
)


def test_references_are_read_as_in_the_sql(spark, tmp_path):
    rows = [(i, "u", f"<title>t</title><article>{b}</article>c") for i, b in enumerate(BODIES)]
    rows += [(80, "u", "<article>p</article>"), (80, "u", "<article>q</article>"), (None, "u", "<article>n</article>")]  # each page is read on its own
    rows += [(90, "u", "<article>open\r\n"), (91, "u", "<p>no</p>"), (92, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, catalogue.q_page_text(spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted(sql.execute(catalogue.SQL["q_page_text"]).fetchall(), key=str)
    assert got[0] == (0, "article", 'a token = &quota token = "9c" b')


def test_layouts_read_all_references(spark):
    frame = spark.createDataFrame([(1, "u", '<div class="entry_body">&quot&copy;&#39;</div>')], "page_id int, url string, html string")
    assert pages.parse(frame).first()["text"] == "\"©'"
    flat = (pages.Site("none", "", "<b>(.*)</b>", posts=False), pages.Site("bare", "", "(<div.*)", posts=False), pages.SITES[2])
    assert [tuple(r) for r in pages.parse(frame, sites=flat).collect()] == [(1, "bare", "\"©'")]
    assert pages.parse(frame, sites=flat).schema == pages.parse(frame).schema


def test_plain_layouts_beside_others(spark):
    plain = pages.Site("plain", "", "<i>(.*)</i>", posts=False, plain=True)
    rows = [(1, "u", "<i>a&lt;/span&gt;</i>"), (2, "u", "<i>\u00a0</i>"), (3, "u", '<div class="entry_body">\u3000\n<span style="color:red">x</span>&lt;/span&gt;</div>')]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    expected = [(1, "plain", "a</span>"), (2, "plain", "\u00a0"), (3, "flat", "x")]
    assert sorted(map(tuple, pages.parse(frame, sites=(plain, *pages.SITES)).collect())) == expected
    assert sorted(map(tuple, pages.parse(frame, sites=(plain, pages.SITES[2])).collect())) == expected
