"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions import rx

# Fixed values.
BORDER = "[|│｜┃]"
WIDE_SPACE = "　"
SITE_PREFIXES = ("安価でやるお！", "やる夫達のいる日常", "やる夫まとめくす", "やる夫短編集")
KANJI_DIGITS = "〇零一二三四五六七八九"
KANJI_VALUES = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000}
POSTER_NAME = "(?:名前|Name)(?U)\\s*[：:]\\s*(.+?)(?:\\[|投稿日|$)"
POSTER_NAME_DATED = "(?U)^\\s*\\d+\\s*[：:]\\s*(.+?)\\s*(?:[：:]|\\[[^\\]]*\\])\\s*\\d{4}[/年]"
POST_HEADER = "(?U)^\\s*\\d+\\s*(?:(?:名前|Name)\\s*[：:]|[：:]\\s*.+?\\s*(?:[：:]|\\[[^\\]]*\\])\\s*\\d{4}[/年])"
COLOR_SPAN = "<span\\s+style=\"color:[^\"]*\">|</span>"
NAME_TAIL = "(?U)[\\s.．。・,，、]+$"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\"", "&quot;"), ("'", "&#x27;"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def normalize_color_tags(text: Column) -> Column:
    """font colours and mixed styles become <span style="color:VALUE">; a style without a value goes."""
    text = F.regexp_replace(text, "<font\\s+color=\"([^\"]+)\"[^>]*>", "<span style=\"color:$1\">")
    text = F.replace(text, F.lit("</font>"), F.lit("</span>"))
    text = F.regexp_replace(text, "<span\\s+style=\"(?![^\"]*color\\s*:\\s*[^;\"\\s])[^\"]*color[^\"]*\">", "")
    return F.regexp_replace(text, "<span\\s+style=\"[^\"]*?color\\s*:\\s*([^;\"]*[^;\"\\s])\\s*(?:;[^\"]*)?\">", "<span style=\"color:$1\">")


def strip_tags_keep_color(text: Column) -> Column:
    """All tags go but colour spans; black spans are unwrapped."""
    text = F.regexp_replace(normalize_color_tags(text), "(?s)<span\\s+style=\"color:\\s*(?:#0{3,6}|black)\\s*\">(.*?)</span>", "$1")
    return F.regexp_replace(text, "<(?!span\\s+style=\"color:|/span>)[^>]+>", "")


def poster_name(header: Column) -> Column:
    """The poster's name in a post header of either form; empty if there is none."""
    named = F.regexp_extract(header, POSTER_NAME, 1)
    name = F.when(header.rlike(POSTER_NAME), named).otherwise(F.regexp_extract(header, POSTER_NAME_DATED, 1))
    return F.regexp_replace(rx.strip(name), "(?U)\\s+", " ")


def is_post_header(line: Column) -> Column:
    return line.rlike(POST_HEADER)


def is_author_post(header: Column, author: Column) -> Column:
    """Whether a header names the author, but for trailing punctuation; without a name, whether it holds the author."""
    name = poster_name(header)
    target = F.regexp_replace(rx.strip(author), "(?U)\\s+", " ")
    bare = lambda c: F.regexp_replace(c, NAME_TAIL, "")
    return F.when(author == "", False).when(name == "", header.contains(author)).otherwise((name == target) | (bare(name) == bare(target)))


def work_title(title: Column) -> Column:
    return rx.strip(F.regexp_replace(title, "(?U)^(?:" + "|".join(rx.quote(p) for p in SITE_PREFIXES) + ")\\s*", ""))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[\\\\/:*?\"<>|]", "_")


def strip_spaces(text: Column) -> Column:
    """Half- and full-width spaces go."""
    return F.translate(text, " " + WIDE_SPACE, "")


def space_out(text: Column) -> Column:
    """Two full-width spaces between the characters of each line."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.array_join(F.split(line, ""), WIDE_SPACE * 2)), "\n")


def escape_html(text: Column) -> Column:
    for char, name in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def unescape_escapes(text: Column | str) -> Column:
    """The references that ``escape_html`` writes decoded, an ampersand's without its semicolon too; all others stay."""
    text = F.col(text) if isinstance(text, str) else text
    for char, name in ESCAPES[1:]:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "&amp;?", "&")


def kanji_to_int(text: Column) -> Column:
    """Kanji or Arabic numerals as a number; null where a character is unknown, or for a zero not written 〇 or 零."""
    values = F.create_map(*[F.lit(x) for pair in KANJI_VALUES.items() for x in pair])

    def step(acc: Column, char: Column) -> Column:
        value = F.try_element_at(values, char)
        unit = value >= 10
        total = F.when(unit, acc["total"] + F.greatest(acc["digit"], F.lit(1)) * value).otherwise(acc["total"])
        digit = F.when(unit, 0).otherwise(value)
        return F.struct(total.alias("total"), digit.alias("digit"), (acc["ok"] & value.isNotNull()).alias("ok"))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(True).alias("ok"))
    found = F.aggregate(F.split(text, ""), zero, step, lambda acc: F.when(acc["ok"], acc["total"] + acc["digit"]))
    kept = F.when((found > 0) | text.isin("〇", "零"), found)
    arabic = F.translate(text, "０１２３４５６７８９", "0123456789")
    return F.when(arabic.rlike("^[0-9]+$"), arabic.try_cast("int")).when(text != "", kept)


def chapter(text: Column) -> Column:
    """The first chapter mark of a text as (number, label); null without one.

    Numbered chapters come first, then side stories, then serials, and a bare number of
    episodes counts on the first line only.
    """
    kanji = "〇零一二三四五六七八九十百千"

    def found(pattern: str, source: Column) -> Column:
        return kanji_to_int(F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")))

    def mark(number: Column, before: str, after: str) -> Column:
        return F.when(number.isNotNull(), F.struct(number.alias("number"), F.concat(F.lit(before), number.cast("string"), F.lit(after)).alias("label")))

    first_line = F.get(F.split(text, "\n", -1), F.lit(0))
    side = F.coalesce(found("(?U)番外編\\s*(\\d+)", text), found(f"(?U)番外編\\s*([{kanji}]+)", text))
    return F.coalesce(
        mark(found("(?U)第\\s*(\\d+)\\s*話", text), "第", "話"),
        mark(found(f"(?U)第\\s*([{kanji}]+)\\s*話", text), "第", "話"),
        mark(side, "番外編", ""),
        mark(found("(?U)その\\s*([０-９\\d]+)", text), "その", ""),
        mark(found("(?U)(?<![第そ])(?<!\\d)([０-９\\d]+)\\s*話", first_line), "第", "話"),
    )


def author_fingerprint(text: Column) -> Column:
    """Date, time and ID of the first post header, or date and time; white space as single spaces."""
    stamp = "\\d{4}/\\d{1,2}/\\d{1,2}\\([^)]*\\)\\s*\\d{1,2}:\\d{2}:\\d{2}(?:\\.\\d+)?"
    found = F.coalesce(F.regexp_substr(text, F.lit(f"{stamp}\\s*ID:[A-Za-z0-9+/.]+")), F.regexp_substr(text, F.lit(stamp)))
    return F.regexp_replace(found, "(?U)\\s+", " ")


def domain(url: Column) -> Column:
    """Lower-case host without www.; of an archived page the host of the original."""
    inner = F.regexp_extract(url, "^https?://web\\.archive\\.org/web/[^/]+/(https?://.*)$", 1)
    target = F.when(inner != "", inner).otherwise(url)
    return F.regexp_replace(F.lower(F.regexp_extract(target, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")


def size_label(n: Column) -> Column:
    """A number of bytes as B, KB or MB."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def css_rgba(color: Column) -> Column:
    """Hex, rgb() and rgba() colours as (r, g, b, a); null for others."""
    color = F.lower(rx.strip(color))
    short = F.regexp_extract(color, "^#([0-9a-f]{3})$", 1)
    full = F.when(short != "", F.concat(*[F.repeat(F.substring(short, i, 1), 2) for i in (1, 2, 3)])).otherwise(F.regexp_extract(color, "^#([0-9a-f]{6})$", 1))
    pair = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    call = "^rgba?\\(\\s*(\\d+)\\s*,\\s*(\\d+)\\s*,\\s*(\\d+)\\s*(?:,\\s*([0-9.]+)\\s*)?\\)$"
    part = lambda i: F.regexp_extract(color, call, i).try_cast("int")
    alpha = F.coalesce(F.regexp_extract(color, call, 4).try_cast("double"), F.lit(1.0))
    kinds = ("r", "g", "b")
    return F.when(full != "", F.struct(*[pair(i).alias(k) for k, i in zip(kinds, (1, 3, 5))], F.lit(1.0).alias("a"))).when(
        color.rlike(call), F.struct(*[part(i).alias(k) for k, i in zip(kinds, (1, 2, 3))], alpha.alias("a"))
    )


def toggle_color(text: Column, color: Column) -> Column:
    """A text in a colour span; one that holds colour markup loses it instead."""
    bare = F.regexp_replace(text, COLOR_SPAN, "")
    return F.when(text.rlike(COLOR_SPAN), bare).otherwise(F.concat(F.lit("<span style=\"color:"), color, F.lit("\">"), text, F.lit("</span>")))


_RUN = "(?s)<span style=\"color:([^\"]+)\">(.*?)</span>"
BLACK = "^(?i)(?:#0{3}|#0{6}|black)$"


def color_runs(text: Column) -> Column:
    """Markup as an array of (text, color) runs; what no span colours is black."""
    run = lambda body, color: F.struct(body.alias("text"), color.alias("color"))

    def build(z: Column) -> Column:
        black = lambda i: run(F.get(z["gaps"], i), F.lit("#000000"))
        pairs = F.transform(z["bodies"], lambda body, i: F.array(run(body, F.get(z["colors"], i)), black(i + 1)))
        return F.filter(F.concat(F.array(black(F.lit(0))), F.flatten(pairs)), lambda x: x["text"] != "")

    parts = F.struct(
        F.split(text, _RUN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(1)).alias("colors"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(2)).alias("bodies")
    )
    return rx.let(parts, build)


def runs_markup(runs: Column) -> Column:
    """Runs as markup; black ones stand without a span."""
    span = lambda x: F.concat(F.lit("<span style=\"color:"), x["color"], F.lit("\">"), x["text"], F.lit("</span>"))
    return F.array_join(F.transform(runs, lambda x: F.when(x["color"].rlike(BLACK), x["text"]).otherwise(span(x))), "")


def chapter_number(text: Column) -> Column:
    """The number of the chapter mark in the first 200 characters; null without one."""
    return chapter(F.substring(text, 1, 200))["number"]


def step_number(number: Column, by: int) -> Column:
    """A number written as text moved by one step, not below zero; an empty one counts as 0, other texts stay."""
    value = F.when(number == "", F.lit(0).cast("long")).otherwise(rx.strip(number).try_cast("long"))
    moved = value + by
    return F.when(value.isNull() | ((moved < 0) if by < 0 else F.lit(False)), number).otherwise(moved.cast("string"))


def output_names(title: Column, number: Column) -> Column:
    """(file_name, display): a title and a number joined by an underscore; an unnamed work has a name of its own."""
    title, number = F.coalesce(F.nullif(rx.strip(title), F.lit("")), F.lit("未命名")), rx.strip(number)
    joined = F.when(number == "", title).otherwise(F.concat_ws("_", title, number))
    return F.struct(safe_file_name(joined).alias("file_name"), joined.alias("display"))
