"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page; lines of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments go with it. A class or id
names such a part only if all its words are of that kind (``ad-box``, ``userComments``);
where one of several words is (``share-price``), or the id of a heading or a part of a line, the element goes only
if most of its text is links. Every other line has a weight. On a page without article or
main it is the length of its text outside of links. Where a page marks its article, lines
in it weigh ``ARTICLE`` times their text. Of several marked regions the heaviest counts,
and those with a quarter of its text; if it is a main element, only such ones. Lines
outside weigh nothing, unless they hold more text than the regions; then they weigh what
exceeds ``OUTSIDE`` characters outside of links. Weights are summed
over windows of ``SPAN`` lines. Text begins at a surge point (the first window of a run
whose sum is at least the threshold at some place) and ends at a dive point (where the
sums fall to nothing); what lies between is kept, block by block, in or out of the mark.

Lines of boilerplate do not part the text around them. Where no window reaches the
threshold, the largest sum of the page is the threshold, so a short text stays.

Cases: a null or empty page has an empty text. Unclosed elements end with the page, but
elements whose end tag may be left out (p, li, dd, dt, option, cells and rows) end at the
start tags that imply it or with their parent, and an unclosed boilerplate element before
the article ends where the article begins. A closed one keeps what is in it, articles
included, unless it is a form or a marked wrapper around all articles and most text. A tag
cut off at the end of the page is dropped; unknown character references stay as they
are. Work grows with the length of a page. Repeated rows are extracted alike. Null ids
and urls stay null. An empty table gives no rows. Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linewright.llm import tables

SPAN = 3
SURGE = 80
ARTICLE = 4
OUTSIDE = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.I | re.S,
)
_MARKED = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)

_BOILERPLATE = set("nav header footer aside form button select menu dialog object embed canvas fieldset head".split())
_MARKS = set(
    "ad ads advert advertisement adverts banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice popup modal overlay comment comments respond reply replies disqus share sharing social "
    "related promo promoted sponsor sponsored newsletter subscribe signup login search pagination pager widget toolbar "
    "complementary contentinfo form alert".split()
)
#: Beside marks these add nothing: what remains is a part of that kind.
_NEUTRAL = set(
    "area article bar bars block body bottom box btn button buttons center col column container content count entry float floating "
    "foot footer global group header holder icon icons inner item items js label left link links list main middle mobile module "
    "page pages panel plugin post posts reader right row section site slot small sticky story text title top unit user users "
    "visible web wrap wrapper wrapping zone".split()
).union(map(str, range(100)))
NONE, WEAK, STRONG = 0, 1, 2
#: Before a mark these say that the page has such a part, not that the element is one.
_HAVING = {"with", "has", "no", "without"}
_ARTICLE = {"article", "main"}
_WHOLE = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: An id of these names a place to jump to.
_ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6"} | _INLINE
#: Elements whose end tag may be left out, and the start tags that end them.
_P_ENDS = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_ROWS = set("tbody thead tfoot".split())
_ENDED_BY = {
    "p": _P_ENDS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr"} | _ROWS, "th": {"td", "th", "tr"} | _ROWS, "tr": {"tr"} | _ROWS, **dict.fromkeys(_ROWS, _ROWS),
}
_PASSED = {"address", "div", "p"}


class Line:
    """The text of one block, how much of it is links, and the number of the marked region that it stands in, 0 outside."""

    __slots__ = ("parts", "linked", "article", "shut")

    def __init__(self, article: int, shut: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.article, self.shut = article, shut


def _mark(name: str, attributes: str) -> int:
    """Whether class, id or role name boilerplate with all their words or with some, or the element is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return NONE
    found = NONE
    for attribute, *groups in _MARKED.findall(attributes):
        for token in _CAMEL.sub("-", next(filter(None, groups), "")).lower().split():
            parts = _NAME_PART.findall(token)
            if any(part in _MARKS and (not i or parts[i - 1] not in _HAVING) for i, part in enumerate(parts)):
                whole = all(part in _MARKS or part in _NEUTRAL for part in parts)
                found = max(found, STRONG if whole and not (attribute.lower() == "id" and name in _ANCHORS) else WEAK)
    return STRONG if found < STRONG and _HIDDEN.search(attributes) else found


class Tag:
    """A tag of the page, how much text and how much of links stands before it, and for a start tag the index of its end tag."""

    __slots__ = ("before", "linked", "name", "closing", "attributes", "alone", "closer")

    def __init__(self, token: re.Match, before: int, linked: int):
        self.before, self.linked = before, linked
        self.name = (token[3] or token[6]).lower()
        self.closing = bool(token[2] or token[5])
        self.attributes = token[4] or token[7] or ""
        self.alone = self.name in _VOID or (self.attributes.endswith("/") and self.name in _INLINE)
        self.closer: int | None = None


def tags_of(page: str) -> tuple[list[Tag], list[list[tuple[int, int]]], int]:
    """The tags in order, the text before each and behind the last as stretches that comments and scripts part, and the length of all text."""
    tags: list[Tag] = []
    texts: list[list[tuple[int, int]]] = [[]]
    open_: dict[str, list[Tag]] = defaultdict(list)
    at = length = linked = 0
    in_link = False
    for token in _TOKEN.finditer(page):
        texts[-1].append((at, token.start()))
        length += token.start() - at
        linked += token.start() - at if in_link else 0
        at = token.end()
        if token[3] is None and token[6] is None:
            continue
        tag = Tag(token, length, linked)
        if tag.name == "a":
            in_link = not tag.closing
        if tag.closing and open_[tag.name]:
            open_[tag.name].pop().closer = len(tags)
        elif not tag.closing and not tag.alone:
            open_[tag.name].append(tag)
        tags.append(tag)
        texts.append([])
    texts[-1].append((at, len(page)))
    return tags, texts, length + len(page) - at


def _end(open_: list[str], name: str) -> bool:
    """Close the last open element of this name and all within; whether there is one."""
    for k in range(len(open_) - 1, -1, -1):
        if open_[k] == name:
            del open_[k:]
            return True
    return False


def _imply_ends(open_: list[str], name: str) -> None:
    """Close the elements that a start tag ends."""
    for k in range(len(open_) - 1, -1, -1):
        if name in _ENDED_BY.get(open_[k], ()):
            del open_[k:]
        elif open_[k] not in _PASSED:
            break


def _shuts(tags: list[Tag], k: int, articles: list[int], length: int) -> bool:
    """Whether the element that tag k starts is boilerplate."""
    tag = tags[k]
    if tag.name in ("html", "body") or tag.name in _ARTICLE:
        return False
    if tag.name in _BOILERPLATE - {"form"}:
        return True
    mark = STRONG if tag.name == "form" else _mark(tag.name, tag.attributes)
    if mark == WEAK and tag.closer is not None:  # what it holds decides
        end = tags[tag.closer]
        mark = STRONG if 2 * (end.linked - tag.linked) > end.before - tag.before else NONE
    if mark != STRONG:
        return False
    if tag.closer is None or not articles or articles[0] < k or tag.closer < articles[-1]:
        return True
    # A wrapper around all articles and most of the text is no part beside them.
    return 2 * (tags[tag.closer].before - tag.before) <= length


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """The lines of a page in order, those of boilerplate included but marked as shut, and which regions are main elements."""
    tags, texts, length = tags_of(page)
    articles = [k for k, tag in enumerate(tags) if tag.name in _ARTICLE and not tag.closing]
    lines: list[Line] = []
    article_end, region = -1, 0  # the tag that ends the outermost region at hand, and its number
    mains: set[int] = set()
    links = 0
    shut: Tag | None = None  # the element that began the boilerplate at hand
    depth = 0
    outer: Counter[str] = Counter()  # open blocks outside of boilerplate
    inner: list[str] = []  # those within boilerplate whose end tag may be left out, itself first
    line = Line(0, False)

    def turn(k: int) -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = Line(region if k < article_end else 0, shut is not None)

    def add(stretches: list[tuple[int, int]]) -> None:
        for s, e in stretches:
            if e > s:
                line.parts.append(page[s:e])
                if links:
                    line.linked += e - s

    for k, tag in enumerate(tags):
        add(texts[k])
        name = tag.name
        if shut is not None:
            if name in _ARTICLE and not tag.closing and shut.closer is None and k >= article_end or name == "body" and shut.name == "head":
                shut = None  # it was never closed
            elif shut.name in _ENDED_BY and name not in _INLINE:
                ended = False
                if not tag.closing:
                    _imply_ends(inner, name)
                    if inner and not tag.alone:
                        inner.append(name)
                elif not _end(inner, name) and outer[name] and name != "p":
                    inner = []  # the end of its parent
                else:
                    ended = not inner
                if inner or ended:
                    shut = shut if inner else None
                    turn(k)
                    continue
                shut = None
            else:
                if name == shut.name and not tag.alone:
                    depth += -1 if tag.closing else 1
                    if depth == 0:
                        shut = None
                        turn(k)
                elif name not in _INLINE:
                    turn(k)
                continue
        if not tag.closing and not tag.alone and _shuts(tags, k, articles, length):
            shut, depth, inner = tag, 1, [name]
            turn(k)
            continue
        if name not in _INLINE and not tag.alone:
            outer[name] = max(0, outer[name] + (-1 if tag.closing else 1))
        if not tag.closing and (name in _ARTICLE or _WHOLE.search(tag.attributes)):
            region += k >= article_end
            if name == "main" or _WHOLE.search(tag.attributes):
                mains.add(region)
            article_end = max(article_end, len(tags) if tag.closer is None else tag.closer)
        if name == "a":
            links = 0 if tag.closing else 1
        elif name not in _INLINE:
            turn(k)
    add(texts[-1])
    turn(len(tags))
    return lines, mains


def kept_lines(weights: list[int], span: int, surge: int) -> list[bool]:
    """Which lines lie between a surge point and the dive point behind it."""
    n = len(weights)
    sums = [sum(weights[i : i + span]) for i in range(n)]
    kept = [False] * n
    i = 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if max(sums[i:j]) >= surge:
            heavy = [k for k in range(i, j) if weights[k]]
            for k in range(heavy[0], heavy[-1] + 1):
                kept[k] = True
        i = j
    return kept


def main_regions(lines: list[Line], texts: list[str], mains: set[int]) -> set[int]:
    """The regions that hold the article: the heaviest outside of links, and those near it."""
    weight: Counter[int] = Counter()
    for line, text in zip(lines, texts):
        if line.article:
            weight[line.article] += max(0, len(text) - line.linked)
    top = max(weight, key=lambda r: (weight[r], -r), default=0)
    return {r for r in weight if 4 * weight[r] >= weight[top] and (r in mains or top not in mains)}


def weights_of(lines: list[Line], texts: list[str], mains: set[int]) -> list[int]:
    kept = main_regions(lines, texts, mains)
    own = [len(text) if line.article in kept else max(0, len(text) - line.linked) for line, text in zip(lines, texts)]
    inside = sum(n for n, line in zip(own, lines) if line.article in kept)
    spared = 0 if not kept else OUTSIDE if 2 * inside < sum(own) else None
    outside = lambda n: 0 if spared is None else max(0, n - spared)
    return [ARTICLE * n if line.article in kept else outside(n) for n, line in zip(own, lines)]


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    """The article's blocks, each with its white space as single spaces, joined by one space."""
    found, mains = lines_of(page or "")
    lines = [line for line in found if not line.shut]  # shut ones do not part the text around them
    texts = [" ".join(html.unescape("".join(line.parts)).split()) for line in lines]
    lines, texts = [line for line, t in zip(lines, texts) if t], [t for t in texts if t]
    weights = weights_of(lines, texts, mains)
    # On a page of short texts only, the heaviest windows are the surge.
    sums = [sum(weights[i : i + span]) for i in range(len(weights))]
    kept = kept_lines(weights, span, min(surge, max(sums, default=0)))
    return " ".join(t for t, k in zip(texts, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tables.read(spark, sf_dir, "pages"))
