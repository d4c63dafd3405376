"""Main text of pages."""

import html
import re

from linewright.llm import mainpage

LONG = "A long sentence of the article goes on for a while, so that it stands out among the lines. " * 3


def test_generated_pages():
    import duckdb

    for _, page in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)[1]
        inner = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"<(/?p|br|/?h1)[^>]*>", " ", inner))
        assert mainpage.main_text(page) == " ".join(html.unescape(inner).split())


def test_page_without_an_article():
    page = f"""<html><head><title>t</title></head><body><header>Site</header><ul class="main-menu"><li>Home</li></ul>
    <div id="sidebar"><p>{LONG}</p></div><div><h1>Head</h1><p>{LONG}</p><p>ok</p><div class="ad-box">buy</div><form>mail <input name=x></form><p>{LONG}</p></div>
    <div class="userComments"><p>{LONG}</p></div><p class="cookie-notice">{LONG}</p><footer>&copy; x</footer><script>var a = "<p>{LONG}</p>";</script></body></html>"""
    body = " ".join(LONG.split())
    assert mainpage.main_text(page) == f"Head {body} ok {body}"


def test_marks_inside_an_article():
    page = f'<article><nav>menu</nav><p>Hi <b>th</b>ere &amp; <i>x</i><br>y&nbsp;z</p><section class="comments"><p>{LONG}</p></section><p>a &lt; b &am'
    assert mainpage.main_text(page) == "Hi there & x y z a < b &am"


def test_broken_pages():
    for page in (None, "", "<", "<p", "<nav>", "<!-- x", "<script>x", "<p class='a>b</p>", "</p></div>", "<a href=x>y", "&", "<article>", "\x00<p>\x00"):
        mainpage.main_text(page)
    assert mainpage.main_text(f"<head><title>x</title><body><nav><li>menu<article><p>{LONG}") == " ".join(LONG.split())


def test_void_elements_shut_nothing():
    assert mainpage.main_text('<article><p>a</p><embed src=x><p>b</p><embed src="y"/>c</article>') == "a b c"


def test_omitted_end_tags():
    for page, text in {
        "<article><p>a<p class=ad>buy <b>now</b><p>b": "a b",
        "<article><p>a<p class=ad>buy<p class=ad>more<h2>b</h2>c": "a b c",
        "<article><ul><li>a<li class=share>x<ul><li>y</ul>z<li>b</ul>c": "a b c",
        "<article><ul><li>a<li class=share><div><p>x</div></ul><p>b": "a b",
        "<article><dl><dt>a<dd class=promo>x<dt>b<dt class=ad>y</dl>c": "a b c",
        "<article><table><tr><td>a<td class=ad>x<td>b<tr class=promo><td>y<tr><td>c</table>d": "a b c d",
        "<article><div><p class=ad>x</div>a": "a",
        "<article><p class=ad>x</p>a<ul><li class=share><p>y</p>z</li><li>b</li></ul>": "a b",
        "<article><p>a<p class=ad>x</article><p>y": "a",
    }.items():
        assert mainpage.main_text(page) == text, page


def test_short_pages_without_an_article():
    assert mainpage.main_text("<body><nav>menu</nav><div><h1>Head</h1><p>Short.</p></div><footer>f</footer>") == "Head Short."
    body = " ".join(LONG.split())
    assert mainpage.main_text(f"<div><p>{LONG}</p><p class=ad>x</p><p class=ad>y</p><p class=ad>z</p><p>The end.</p></div>") == f"{body} The end."
    assert mainpage.main_text("<nav>menu</nav>") == ""


def test_surge_and_dive():
    assert mainpage.kept_lines([0, 5, 0, 0, 0, 90, 0, 4, 0, 0, 0, 7], 3, 80) == [False] * 5 + [True] * 3 + [False] * 4
    assert mainpage.kept_lines([], 3, 80) == []


def test_boilerplate_keeps_its_articles():
    body = " ".join(LONG.split())
    assert mainpage.main_text(f"<main><p>{LONG}</p></main><aside><article><p>teaser</p></article></aside>") == body
    assert mainpage.main_text(f"<aside><article><p>teaser</p></article></aside><div><p>{LONG}</p></div>") == body
    assert mainpage.main_text(f"<form id=all><nav>x</nav><article><p>{LONG}</p></article></form>") == body


def test_marks_of_layouts():
    body = " ".join(LONG.split())
    assert mainpage.main_text(f'<body><div class="layout with-sidebar"><p>{LONG}</p></div></body>') == body
    assert mainpage.main_text(f'<div class="page hasSidebar no-footer"><p>{LONG}</p><div class="page-footer">x</div></div>') == body


def _by_brute_force(weights, texts, span, surge):
    """Keep every line that some reaching run of windows holds between its outermost lines of weight."""
    n = len(weights)
    surge = min(surge, max((sum(weights[i : i + span]) for i in range(n)), default=0))
    kept = set()
    for i in range(n):
        for j in range(i, n):
            runs = all(sum(weights[k : k + span]) for k in range(i, j + 1))
            if runs and any(sum(weights[k : k + span]) >= surge for k in range(i, j + 1)):
                heavy = [k for k in range(i, j + 1) if weights[k]]
                kept |= set(range(heavy[0], heavy[-1] + 1)) if heavy else set()
    return " ".join(t for k, t in enumerate(texts) if k in kept)


def _layouts():
    """Pages of random blocks, with and without an article, and what each line weighs."""
    import random

    r = random.Random(5)
    for _ in range(300):
        marked, blocks, weights, texts = r.random() < 0.5, [], [], []
        for _ in range(r.randint(1, 14)):
            text = " ".join("word" for _ in range(r.choice([1, 2, 3, 20, 80])))
            kind = r.choice(["p", "link", "article" if marked else "p", "nav"])
            blocks.append({"p": f"<p>{text}</p>", "link": f"<p><a href=x>{text}</a></p>", "article": f"<article>{text}</article>", "nav": f"<nav>{text}</nav>"}[kind])
            if kind != "nav":
                texts.append(text)
                weights.append((kind, len(text)))
        regions = [n for k, n in weights if k == "article"]
        near = lambda k, n: k == "article" and 4 * n >= max(regions)
        inside = sum(n for k, n in weights if near(k, n))
        outside = sum(n for k, n in weights if not near(k, n) and k != "link")
        spared = 0 if not regions else mainpage.OUTSIDE if inside < outside else 1 << 30
        yield "".join(blocks), [mainpage.ARTICLE * n if near(k, n) else 0 if k == "link" else max(0, n - spared) for k, n in weights], texts, bool(regions)


def test_whole_pages_by_brute_force():
    for page, weights, texts, _ in _layouts():
        assert mainpage.main_text(page) == _by_brute_force(weights, texts, mainpage.SPAN, mainpage.SURGE)


def test_line_blocks_decide(monkeypatch):
    made = [(page, mainpage.main_text(page), has) for page, _, _, has in _layouts()]
    monkeypatch.setattr(mainpage, "kept_lines", lambda weights, span, surge: [True] * len(weights))
    changed = [has for page, text, has in made if mainpage.main_text(page) != text]
    assert changed.count(True) > 50 and changed.count(False) > 20


def test_a_very_long_page():
    page = f"<article>{f'<p>{LONG}</p><div class=ad>x</div>' * 20000}</article>"
    assert len(mainpage.main_text(page)) == 20000 * (len(" ".join(LONG.split())) + 1) - 1


def test_operator(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    pages = spark.createDataFrame([(1, "u", f"<article>{LONG}</article>", "x", 1), (None, None, None, None, None), (1, "u", "", "x", 1)], schema)
    rows = mainpage.extract(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, len(" ".join(LONG.split()))]
    assert mainpage.extract(pages.limit(0)).count() == 0


def test_words_of_an_article_are_no_marks():
    """Class and id words that only sound like boilerplate, in an article and without one."""
    body = " ".join(LONG.split())
    links = "".join(f"<a href=x>link {i}</a> " for i in range(9))
    held = f'<p class="share-price">{LONG}</p><h2 id="search">Search</h2><section id="related-work"><p>{LONG}</p></section><div class="form-of-government">{LONG}</div>'
    for page in (f"<article>{held}</article>", f"<body><div>{held}</div></body>"):
        assert mainpage.main_text(page) == f"{body} Search {body} {body}"
    gone = f'<div class="share-this-story">{links}</div><ul class="related-posts"><li>{LONG}</li></ul><div id="comments-3">{LONG}</div><div class="js-share-buttons">x</div>'
    assert mainpage.main_text(f"<article><p>{LONG}</p>{gone}<p>end</p></article>") == f"{body} end"


def test_the_heaviest_region_is_the_article():
    body = " ".join(LONG.split())
    teaser = "<div><article><h2>Teaser</h2><p>Short words on something else.</p></article></div>"
    assert mainpage.main_text(f"<main><article><p>{LONG}</p></article></main>{teaser}") == body
    assert mainpage.main_text(f"{teaser * 3}<article><p>{LONG}</p></article>{teaser}") == body
    assert mainpage.main_text(f"<main><p>{LONG}</p></main><article><p>{LONG}</p></article>") == body
    assert mainpage.main_text(f"<article>{LONG}</article><div>{LONG}{LONG[:90]}</div><article><p>{LONG}</p></article>") == f"{body} {body} {LONG[:90].strip()} {body}"
    assert mainpage.main_text(f"<article><p>{LONG}</p><p>{LONG}</p></article><p>{LONG}</p>") == f"{body} {body}"


PAGES = {  # as sites of several kinds write them: (page, its text)
    "forum": (f'<div id="page-body"><div class="navbar"><a href="/">Index</a></div><div class="post" id="p1"><h3><a href="#p1">Topic</a></h3><div class="content">{LONG}</div></div>'
              f'<div class="post" id="p2"><div class="content">{LONG}</div></div><div id="page-footer">Powered</div></div>', f"{LONG} {LONG}"),
    "wiki": (f'<div id="content" role="main"><h1 id="firstHeading">Form</h1><div id="bodyContent"><p>{LONG}</p><h2><span id="Search">Search</span></h2><p>{LONG}</p>'
             '<div class="navbox" role="navigation"><a href=a>A</a><a href=b>B</a></div></div></div><div id="mw-navigation"><a href=c>Log in</a></div>', f"Form {LONG} Search {LONG}"),
    "news": (f'<header>Paper</header><main><article itemprop="articleBody"><h1>Head</h1><p>{LONG}</p><aside>Read also</aside><p>Last.</p></article></main>'
             f'<section class="more"><article><h3>Other</h3><p>News</p></article><article><h3>More</h3><p>News</p></article></section><footer>x</footer>', f"Head {LONG} Last."),
    "blog": (f'<div class="site has-sidebar"><div class="entry"><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><div class="sharing-buttons"><a href=x>Tweet</a></div></div>'
             f'<div class="widget-area"><p>{LONG}</p></div><div class="comments-area"><p>{LONG}</p></div></div>', f"Title {LONG} {LONG}"),
}


def test_pages_as_sites_write_them():
    for name, (page, text) in PAGES.items():
        assert mainpage.main_text(page) == " ".join(text.split()), name
