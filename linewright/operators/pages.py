"""Page parsing: titles, navigation, posts and author blocks, by regular expressions as columns.

A site is an entry of ``SITES``: patterns for the container of posts, for the block of
related links and its items, and how the title is found. ``parse`` tries the site whose
domain fits, then the others in order, and takes the first with text; ``result`` adds the
title and the links of that layout. All layouts are tried in one pass over the pages,
which page_id must tell apart where posts or an author are looked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import arrow, nesting, rx, scalar

LINK = "(?s)<a\\s[^>]*?href=\"([^\"]+)\"[^>]*>(.*?)</a>"
BREAK = "<br\\s*/?>"
POST = "(?s)<dt(?:\\s[^>]*)?>(.+?)</dt>\\s*<dd(?:\\s[^>]*)?>(.*?)(?=<dt|</dl>|</dd>|$)"


@dataclass(frozen=True)
class Site:
    """Where a kind of page keeps its parts; ``domain`` is a part of the host, empty for any."""

    name: str
    domain: str
    body: str  # group 1 is the text of the page
    related: str = "(?s)<dl\\s+class=\"relate_dl[^\"]*\">(.*?)</dl>"
    item: str = "(?s)<li\\s+class=\"relate_li(?:_nolink)?\"[^>]*>.*?</li>"
    item_break: str = ""
    title: str = "<title>([^<]+)</title>"
    title_cut: str = ""  # what does not belong to the title
    posts: bool = True
    later: str = ""  # a second block of links, in order of time; the first runs backwards
    current: str = ""  # what marks the item of the current page
    joined_breaks: bool = False  # a line feed behind a break says nothing
    flat_cut: str = ""  # markup to drop where posts are not marked up
    nested: str = ""  # the opening div of a block of links that may hold further divs
    plain: bool = False  # flat text where, unless an author is asked for, all tags go before references are read and only ASCII white space is blank


_LATER_LIST = "(?s)<ul\\s+[^>]*class=\"[^\"]*relatedPostsWrap\\s+relatedPostsNext[^\"]*\"[^>]*>(.*?)</ul>"
_EARLIER_LIST = "(?s)<ul\\s+[^>]*class=\"[^\"]*relatedPostsWrap\\s+relatedPostsPrev[^\"]*\"[^>]*>(.*?)</ul>"
_ITEM = "(?s)<li[^>]*>.*?</li>"
_BOOK_TITLE = "\\s*[|｜\\-－–—]\\s*やる夫ブック.*$"


# The page layouts known, the default first.
SITES = (
    Site("default", "", "(?s)<div\\s+class=\"article\">(.*?)(?=<dl\\s+class=\"relate_dl\">|<div\\s+class=\"article\">|$)", title_cut="^.*?まとめ\\S*\\s+"),
    Site(
        "dt-list", "himanatokiniyaruo.com", "(?s)(<dt\\s+id=\"\\d+\".*?)(?=<div\\s+class=\"related[^\"]*\"|$)",
        related="(?s)<div\\s+class=\"related-entries\">(.*?)</div>", nested="<div\\s+class=\"related-entries\">", item_break=BREAK, title="<h2[^>]*>\\s*<a[^>]+class=\"kjax\"[^>]*>([^<]+)</a>\\s*</h2>",
    ),
    Site(
        "flat", "blog.fc2.com",
        "(?s)<div\\s+class=\"(?:ently_text|entry_body)\">(.*?)(?=<div\\s+class=\"fc2button-clap[^\"]*\"|<dl\\s+class=\"relate_dl|<!--/ently_text-->|<!--/entry_body-->|$)",
        posts=False,
    ),
    Site(
        "res-list", "yaruobook.jp",
        "(?s)(<dt\\s+[^>]*class=\"[^\"]*author-res-dt.*?|<dt[^>]*>(?:\\s|<[^>]+>)*\\d+(?:\\s|<[^>]+>)*[：:].*?\\d{4}[/年].*?)"
        "(?=<div\\s+[^>]*class=\"[^\"]*widget-single-content-bottom|<ul\\s+[^>]*class=\"[^\"]*relatedPostsWrap|$)",
        related=_EARLIER_LIST, later=_LATER_LIST, item=_ITEM, current="currentPost", title_cut=_BOOK_TITLE,
    ),
    Site(
        "entry", "yaruobook.net",
        "(?s)<div\\s+id=\"entry-content\"[^>]*>(.*?)(?=<div\\s+id=\"custom_html-|<div\\s+[^>]*class=\"[^\"]*widget-single-content-bottom|<ul\\s+[^>]*class=\"[^\"]*relatedPostsWrap|$)",
        related=_EARLIER_LIST, later=_LATER_LIST, item=_ITEM, current="currentPost", title_cut=_BOOK_TITLE,
    ),
    Site(
        "matome", "yaruo-matome.com",
        "(?s)<div\\b[^>]*\\bid=\"entry-content\"[^>]*>(.*?)(?=<ul\\b[^>]*\\bclass=\"[^\"]*nexe-prev-post|<div\\b[^>]*\\bclass=\"[^\"]*wp-block-related|<div\\b[^>]*\\bid=\"comments\"|$)",
        related="(?s)<ul\\b[^>]*\\bclass=\"[^\"]*nexe-prev-post[^\"]*\"[^>]*>(.*?)</ul>", item=_ITEM, joined_breaks=True,
        title_cut="\\s*[|｜\\-－–—]\\s*.{0,20}まとめ.*$",
        flat_cut="(?s)<button\\b[^>]*>.*?</button>|<span\\b[^>]*\\bclass=['\"][^'\"]*wpfp[^'\"]*['\"][^>]*>.*?</span>",
    ),
)


def text_of(fragment: Column, decode: Callable[[Column], Column] = arrow.unescape_html) -> Column:
    """Markup without tags and references, trimmed."""
    return rx.strip(decode(scalar.strip_tags(fragment)))


def _by_site(sites: tuple[Site, ...]) -> Callable[[Callable[[Site], Column]], Column]:
    """A column of the site that a row names; that of the first site where it names none."""

    def pick(made: Callable[[Site], Column]) -> Column:
        chosen = made(sites[0])
        for site in sites[1:]:
            chosen = F.when(F.col("site") == site.name, made(site)).otherwise(chosen)
        return chosen

    return pick


def _titles(pages: DataFrame, pick) -> DataFrame:
    own, usual = pick(lambda s: F.regexp_extract("html", s.title, 1)), F.regexp_extract("html", "<title>([^<]+)</title>", 1)
    rows = pages.withColumn("_t", arrow.unescape_html(F.when(own != "", own).otherwise(usual)))
    named = rx.strip(F.col("_t"))
    return rows.select("page_id", pick(lambda s: F.regexp_replace(named, s.title_cut, "") if s.title_cut else named).alias("title"))


def title(pages: DataFrame, site: Site = SITES[0]) -> DataFrame:
    """(page_id, title): by the site's own pattern, else by the title element."""
    return _titles(pages, _by_site((site,)))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, title) of every link of a page, in order; urls are made absolute."""
    found = F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label")))
    rows = pages.select("page_id", F.col("url").alias("base"), found.alias("pos", "a"))
    return rows.select("page_id", "pos", arrow.url_join("base", F.col("a.href")).alias("url"), text_of(F.col("a.label")).alias("title"))


def balanced_block(page: Column, opening: str) -> Column:
    """What lies between the first match of an opening div and the close of the same level; empty without one.

    The depth is a running sum over the div tags behind the opening.
    """
    rest = F.get(F.split(page, opening, 2), F.lit(1))

    def inner(text: Column) -> Column:
        tags = rx.matches(text, "<div(?=[\\s>])|</div>")

        def step(acc: Column, tag: Column) -> Column:
            depth = acc["depth"] + F.when(tag["text"] == "</div>", -1).otherwise(1)
            end = F.when(acc["end"].isNull() & (depth == 0), tag["start"]).otherwise(acc["end"])
            return F.struct(depth.alias("depth"), end.alias("end"))

        end = F.aggregate(tags, F.struct(F.lit(1).alias("depth"), F.lit(None).cast("int").alias("end")), step, lambda acc: acc["end"])
        return F.coalesce(F.substring(text, F.lit(1), end), F.lit(""))

    return F.when(rest.isNull(), "").otherwise(rx.let(rest, inner))


def _related(pages: DataFrame, pick) -> DataFrame:
    def items(site: Site, pattern: str) -> Column:
        block = F.regexp_extract("html", pattern, 1)
        if site.nested:  # where the plain block has no link, the one up to the close of the same level
            block = F.when(block.rlike(LINK), block).otherwise(balanced_block(F.col("html"), site.nested))
        return F.split(block, site.item_break, -1) if site.item_break else F.regexp_extract_all(block, F.lit(site.item), F.lit(0))

    def every(site: Site) -> Column:
        first = F.reverse(items(site, site.related))
        return F.concat(first, items(site, site.later)) if site.later else first

    kept = [F.col("site")] if "site" in pages.columns else []
    rows = pages.select("page_id", *kept, F.col("url").alias("base"), F.posexplode(pick(every)).alias("pos", "item"))
    href = F.nullif(F.regexp_extract("item", LINK, 1), F.lit(""))
    label = F.when(href.isNotNull(), F.regexp_extract("item", LINK, 2)).otherwise(F.col("item"))
    rows = rows.select("*", href.alias("href"), text_of(label).alias("title")).withColumn("url", F.when(F.col("href").isNotNull(), arrow.url_join("base", "href")))
    bare = lambda c: F.regexp_replace(c, "/+$", "")

    def current(site: Site) -> Column:
        if site.current:
            return F.regexp_extract("item", "^<li[^>]*>", 0).contains(site.current)
        if site.item_break:
            return F.col("url").isNull() | (bare(F.col("url")) == bare(F.col("base")))
        return F.col("url").isNull()

    return rows.filter("title <> ''").select("page_id", "pos", "title", "url", pick(current).alias("is_current"))


def navigation(pages: DataFrame, site: Site = SITES[0]) -> DataFrame:
    """(page_id, pos, title, url, is_current) of a page's related links, oldest first.

    The current page is the item with the site's mark; where a site has none, an item
    without a link, and where items are set off by breaks a link to the page itself too.
    """
    return _related(pages, _by_site((site,)))


def adjacent(nav: DataFrame) -> DataFrame:
    """(page_id, previous, next): the urls beside the first current entry."""
    order = Window.partitionBy("page_id").orderBy("pos")
    rows = nav.withColumn("previous", F.lag("url").over(order)).withColumn("next", F.lead("url").over(order))
    return rows.filter("is_current").groupBy("page_id").agg(F.min_by(F.struct("previous", "next"), "pos").alias("at")).select("page_id", "at.previous", "at.next")


def posts(
    pages: DataFrame, body: Column, author: str = "", author_only: bool = False, keys: tuple[str, ...] = ("page_id",), decode: Callable[[Column], Column] = arrow.unescape_html
) -> DataFrame:
    """(*keys, post_no, header, poster, is_author, text) of the dt / dd posts of a page.

    The author's posts keep their colours. With ``author_only`` and no name, the first
    poster named on the page is the author. ``decode`` reads character references.
    """
    found = F.posexplode(F.arrays_zip(F.regexp_extract_all(body, F.lit(POST), F.lit(1)).alias("dt"), F.regexp_extract_all(body, F.lit(POST), F.lit(2)).alias("dd")))
    rows = pages.select(*keys, found.alias("post_no", "p")).select(*keys, "post_no", text_of(F.col("p.dt"), decode).alias("header"), F.regexp_replace("p.dd", BREAK, "\n").alias("dd"))
    rows = rows.withColumn("poster", scalar.poster_name(F.col("header")))
    named = F.lit(author)
    if author_only and not author:
        whole = Window.partitionBy(*keys)
        rows = rows.withColumn("_author", F.coalesce(F.min_by("poster", F.when(F.col("poster") != "", F.col("post_no"))).over(whole), F.lit("")))
        named = F.col("_author")
    rows = rows.withColumn("is_author", scalar.is_author_post(F.col("header"), named))
    if author_only:
        rows = rows.filter((named == "") | F.col("is_author"))
    colored = rx.let(scalar.strip_tags_keep_color(F.col("dd")), nesting.drop_unmatched_spans)
    # A generator keeps the body apart from the function that decodes it.
    plain = rows.select("*", F.explode(F.array(F.when(F.col("is_author"), colored).otherwise(scalar.strip_tags(F.col("dd"))))).alias("_body"))
    body_text = decode(F.col("_body"))
    trimmed = F.regexp_replace(body_text, "(?U)(?:(?:^|\\n)[\\s&&[^\\n]]*)+\\z", "")
    done = plain.withColumn("_text", trimmed).filter(~rx.is_blank(F.col("_text")))
    return done.select(*keys, "post_no", "header", "poster", "is_author", F.concat_ws("\n", "header", "_text").alias("text"))


def first_poster(lines: DataFrame, *keys: str) -> DataFrame:
    """The first poster named in a header line: (*keys, author); pages are told apart by page_id unless keys are given."""
    keys = keys or ("page_id",)
    bare = F.regexp_replace("line", scalar.COLOR_SPAN, "")
    named = lines.filter(scalar.is_post_header(bare)).select(*keys, "line_no", scalar.poster_name(bare).alias("name")).filter("name <> ''")
    return named.groupBy(*keys).agg(F.min_by("name", "line_no").alias("author"))


def author_blocks(lines: DataFrame, author: str, author_only: bool = False, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Lines with the author's colours kept and the others' dropped; with ``author_only`` the others' posts go.

    A header decides for the lines that follow it; lines before the first are nobody's.
    """
    bare = F.regexp_replace("line", scalar.COLOR_SPAN, "")
    rows = lines.withColumn("_bare", bare).withColumn("is_header", scalar.is_post_header(F.col("_bare")))
    named = F.lit(author)
    if author_only and not author:
        rows = rows.join(first_poster(lines, *keys), list(keys), "left").withColumn("_author", F.coalesce("author", F.lit(""))).drop("author")
        named = F.col("_author")
    flag = F.when(F.col("is_header"), scalar.is_author_post(F.col("_bare"), named))
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_author", F.coalesce(F.last(flag, ignorenulls=True).over(so_far), F.lit(False)))
    if author_only:
        rows = rows.filter("is_author")
    text = F.when(F.col("is_author") & ~F.col("is_header"), F.col("line")).otherwise(F.col("_bare"))
    return rows.select(*keys, "line_no", text.alias("line"), "is_header", "is_author")


_KEYS = ("page_id", "rank", "site")


def _tries(sites: tuple[Site, ...]) -> list[Column]:
    """(rank, site, body) by each layout, null bodies where it does not fit; the one of the page's domain comes first."""
    host = scalar.domain(F.col("url"))

    def tried(i: int, site: Site) -> Column:
        body = F.when(F.col("html").rlike(site.body), F.regexp_extract("html", site.body, 1))
        if site.joined_breaks:
            body = F.regexp_replace(body, f"{BREAK}[ \\t]*\\n", "<br />")
        rank = F.when(host.contains(site.domain) if site.domain else F.lit(False), -1).otherwise(i)
        return F.struct(rank.alias("rank"), F.lit(site.name).alias("site"), body.alias("body"))

    return [tried(i, s) for i, s in enumerate(sites)]


def _bodies(pages: DataFrame, sites: tuple[Site, ...]) -> DataFrame:
    """(page_id, rank, site, body) for every layout that fits a page."""
    return pages.select("page_id", F.inline(F.array(*_tries(sites)))).filter("body IS NOT NULL")


def _flat_markup(body: Column, plain: bool) -> Column:
    """Markup without links, its breaks as line feeds, and of its tags only colours; if plain, none."""
    flat = F.regexp_replace(F.regexp_replace(body, "(?s)<a\\s[^>]*>.*?</a>", ""), BREAK, "\n")
    return scalar.strip_tags(flat) if plain else scalar.strip_tags_keep_color(flat)


def _uncolored(text: Column, plain: bool) -> Column:
    return text if plain else F.regexp_replace(text, scalar.COLOR_SPAN, "")


def _without_blank_ends(text: Column, plain: bool) -> Column:
    space = "[ \\t\\f\\r]" if plain else "[\\s&&[^\\n]]"
    return F.regexp_replace(text, f"(?U)^(?:{space}*\\n)+|(?:\\n{space}*)+\\z", "")


def _has_text(text: Column, plain: bool) -> Column:
    return text.rlike("[^ \\t\\n\\f\\r]") if plain else ~rx.is_blank(text)


def _flat(bodies: DataFrame, author: str, author_only: bool, decode: Callable[[Column], Column], plain: bool = False) -> DataFrame:
    """Text, if there is any, whose posts are told apart by their header lines alone."""
    plain = plain and not (author or author_only)
    rows = bodies.select(*_KEYS, decode(_flat_markup(F.col("body"), plain)).alias("text"))
    if author or author_only:
        lines = rows.select(*_KEYS, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        kept = author_blocks(lines, author, author_only, _KEYS)
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        rows = kept.groupBy(*_KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    else:
        rows = rows.withColumn("text", _uncolored(F.col("text"), plain))
    # A generator, so that a filter behind does not read the text anew.
    return rows.select(*_KEYS, F.explode(F.array(_without_blank_ends(F.col("text"), plain))).alias("text")).filter(_has_text(F.col("text"), plain))


def _page_by_page(pages: DataFrame, sites: tuple[Site, ...], decode: Callable[[Column], Column]) -> DataFrame:
    """As ``parse`` without an author, for layouts that are all read flat: nothing is shuffled, and pages may share a page_id."""
    rows = pages.select("page_id", *(t.alias(f"_{i}") for i, t in enumerate(_tries(sites))))
    marked = rows.select("*", *(_flat_markup(F.col(f"_{i}.body"), s.plain).alias(f"_m{i}") for i, s in enumerate(sites)))
    texts = (_without_blank_ends(_uncolored(decode(F.col(f"_m{i}")), s.plain), s.plain) for i, s in enumerate(sites))
    read = marked.select("page_id", F.array(*(F.struct(f"_{i}.rank", f"_{i}.site", t.alias("text")) for i, t in enumerate(texts))).alias("_read"))
    plain = [s.name for s in sites if s.plain]
    held = lambda x: F.when(x["site"].isin(plain), _has_text(x["text"], True)).otherwise(_has_text(x["text"], False))
    best = F.array_min(F.filter("_read", held))
    return read.select("page_id", F.inline(F.array(best))).select("page_id", "site", "text")


def parse(
    pages: DataFrame, author: str = "", author_only: bool = False, sites: tuple[Site, ...] = SITES, decode: Callable[[Column], Column] = arrow.unescape_html
) -> DataFrame:
    """(page_id, site, text): the text of each page by the first layout that finds some; null if none does.

    Pages without marked-up posts, where a layout says how they are read flat, are so read
    if a post header stands in them. ``decode`` reads character references.
    """
    if not (author or author_only or any(s.posts for s in sites)):
        return _page_by_page(pages, sites, decode)
    bodies = _bodies(pages, sites)
    named = lambda held: F.col("site").isin(*[s.name for s in sites if held(s)])
    rows = posts(bodies.filter(named(lambda s: s.posts)), F.col("body"), author, author_only, _KEYS, decode)
    ordered = F.array_sort(F.collect_list(F.struct("post_no", "text")))
    found = rows.groupBy(*_KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
    texts = found
    for plain in sorted({s.plain for s in sites if not s.posts}):
        texts = texts.unionByName(_flat(bodies.filter(named(lambda s: not s.posts and s.plain == plain)), author, author_only, decode, plain))
    if any(s.posts and s.flat_cut for s in sites):
        rest = bodies.filter(named(lambda s: s.posts and s.flat_cut)).join(found.select(*_KEYS), list(_KEYS), "left_anti")
        for site in sites:
            if site.flat_cut:
                rest = rest.withColumn("body", F.when(F.col("site") == site.name, F.regexp_replace("body", site.flat_cut, "")).otherwise(F.col("body")))
        texts = texts.unionByName(_flat(rest, author, author_only, decode).filter(F.exists(F.split("text", "\n", -1), lambda line: scalar.is_post_header(line))))
    best = texts.groupBy("page_id").agg(F.min_by(F.struct("site", "text"), "rank").alias("b"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", "b.site", "b.text")


def result(pages: DataFrame, author: str = "", author_only: bool = False, sites: tuple[Site, ...] = SITES) -> DataFrame:
    """(page_id, site, title, text, links, status): what a reader of a page wants, by the layout that gave its text.

    text is the title, a blank line and the page's text. links are (title, url, is_current)
    from the oldest on. status is ``text``; ``author`` where the page has text, but none by
    the author who alone was asked for; else ``none``. Pages without a text have no links.
    """
    read = parse(pages, author, author_only, sites)
    if author_only and author:
        lost = pages.join(read.filter("text IS NULL").select("page_id"), "page_id", "left_semi")
        others = parse(lost, sites=sites).filter("text IS NOT NULL").select("page_id", F.lit("author").alias("_others"))
        read = read.join(others, "page_id", "left")
    else:
        read = read.withColumn("_others", F.lit(None).cast("string"))
    status = F.when(F.col("text").isNotNull(), "text").otherwise(F.coalesce("_others", F.lit("none")))
    sited = pages.select("page_id", "url", "html").join(read.filter("text IS NOT NULL").select("page_id", "site"), "page_id")
    pick = _by_site(sites)
    links_of = _related(sited, pick).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "is_current"))).alias("_links"))
    rows = read.withColumn("status", status).join(_titles(sited, pick), "page_id", "left").join(links_of, "page_id", "left")
    whole = F.when(F.col("title") != "", F.concat_ws("\n\n", "title", "text")).otherwise(F.col("text"))
    found = F.transform("_links", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["is_current"].alias("is_current")))
    return rows.select("page_id", "site", "title", F.when(F.col("text").isNotNull(), whole).alias("text"), found.alias("links"), "status")
