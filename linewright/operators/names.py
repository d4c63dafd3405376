"""Pairs of a Japanese and a Chinese name from list pages, by three strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import arrow, rx

# Characters and layouts of names.
KANA = "[\\u3040-\\u309f\\u30a0-\\u30ff]"
HAN = "[\\u4e00-\\u9fff]"
EDGES = "[　 \\t\\r\\n，,、。.；;：:()（）\\[\\]［］【】「」『』\"']"
JA_SPAN = "(?is)<span\\b[^>]*\\blang=\"ja\"[^>]*>(.*?)</span>"
LOOK_BACK = 400


def plain(fragment: Column) -> Column:
    """Markup without comments, footnotes and tags."""
    bare = F.regexp_replace(fragment, "(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, "(?is)<sup\\b[^>]*>.*?</sup>", "")
    return F.regexp_replace(bare, "<[^>]+>", "")


def clean(name: Column) -> Column:
    return F.regexp_replace(rx.strip(name), f"^{EDGES}+|{EDGES}+$", "")


def is_japanese(name: Column) -> Column:
    return (name != "") & (F.lower(rx.strip(name)) != "ja") & name.rlike(f"{KANA}|{HAN}")



_FOUND = "array<struct<strategy:int,pos:int,jp:string,cn:string>>"


def _row(strategy: int, pos: Column, jp: Column, cn: Column) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), pos.alias("pos"), jp.alias("jp"), cn.alias("cn"))


def from_terms(html: Column) -> Column:
    """A definition term begins with the Chinese name and holds the Japanese one."""
    in_brackets = "[（(][^（()）]*?[，,、]\\s*([^（()）]+?)\\s*[)）]"

    def pair(dt: Column, i: Column) -> Column:
        marked = F.transform(F.regexp_extract_all(dt, F.lit(JA_SPAN), F.lit(1)), lambda s: clean(plain(s)))
        listed = F.transform(F.regexp_extract_all(plain(dt), F.lit(in_brackets), F.lit(1)), clean)
        first = lambda names: F.get(F.filter(names, is_japanese), F.lit(0))
        return _row(0, i, F.coalesce(first(marked), first(listed)), clean(F.regexp_extract(dt, "^\\s*([^<]+)", 1)))

    terms = F.regexp_extract_all(html, F.lit("(?is)<dt\\b[^>]*>(.*?)</dt>"), F.lit(1))
    return F.filter(F.transform(terms, pair), lambda x: (x["cn"] != "") & x["jp"].isNotNull())


def from_tables(html: Column) -> Column:
    """Of a row's first three cells, the first with kana and the first with Han characters but no kana."""
    tables = F.regexp_extract_all(html, F.lit("(?is)<table\\b[^>]*class=\"[^\"]*wikitable[^\"]*\"[^>]*>(.*?)</table>"), F.lit(1))
    rows = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))))

    def pair(row: Column, i: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
        cells = F.transform(F.slice(raw, 1, 3), lambda c: clean(plain(c)))
        jp = F.get(F.filter(cells, lambda c: c.rlike(KANA)), F.lit(0))
        cn = F.get(F.filter(cells, lambda c: c.rlike(HAN) & ~c.rlike(KANA)), F.lit(0))
        return F.when(F.size(raw) >= 2, _row(1, i, jp, cn))

    return F.filter(F.transform(rows, pair), lambda x: x["jp"].isNotNull() & x["cn"].isNotNull())


def from_spans(html: Column) -> Column:
    """Before a Japanese span stands the Chinese name, at the end of the text that precedes it."""

    def pair(m: Column, i: Column) -> Column:
        before = F.substring(html, F.greatest(m["start"] - LOOK_BACK, F.lit(0)) + 1, F.least(m["start"], F.lit(LOOK_BACK)))
        before = F.regexp_replace(F.regexp_replace(plain(before), "[（(]\\s*$", ""), "(?U)\\s+$", "")
        return _row(2, i, clean(plain(F.regexp_extract(m["text"], JA_SPAN, 1))), clean(F.regexp_extract(before, "(?U)([\\u4e00-\\u9fff·・‧\\s]+)$", 1)))

    named = F.transform(rx.matches(html, JA_SPAN), pair)
    return F.filter(named, lambda x: is_japanese(x["jp"]) & x["cn"].rlike(HAN) & ~x["cn"].rlike(KANA))


def pairs(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, pos, jp, cn), each Japanese name once per page, by the earliest strategy.

    Character references are decoded first, but for those that would read as markup, which
    are decoded in the names. page_id must tell pages apart.
    """
    guarded = F.regexp_replace("html", "(?i)&(?=(?:lt|gt|amp|quot|#0*(?:34|38|60|62)|#x0*(?:22|26|3c|3e));?)", "&amp;")
    decoded = pages.select("page_id", arrow.unescape_html(guarded).alias("html"))
    html = F.col("html")
    every = F.concat(*(f(html).cast(_FOUND) for f in (from_terms, from_tables, from_spans)))
    both = decoded.select("page_id", F.inline(every))
    cleaned = both.withColumn("jp", clean(arrow.unescape_html("jp"))).withColumn("cn", clean(arrow.unescape_html("cn")))
    usable = cleaned.filter((F.col("cn") != "") & (F.col("jp") != F.col("cn")) & is_japanese(F.col("jp")))
    first = Window.partitionBy("page_id", "jp").orderBy("strategy", "pos")
    return usable.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def as_glossary(found: DataFrame) -> DataFrame:
    """Per page its pairs as lines ``jp=cn``."""
    row = F.struct("strategy", "pos", F.concat_ws("=", "jp", "cn").alias("row"))
    return found.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]), "\n").alias("text"))
