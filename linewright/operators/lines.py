"""Documents as lines, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import rx


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) for every line; a null text has none."""
    return docs.select(key, F.posexplode(split_lines(F.col(text))).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def from_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents put together again from their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def first_line_with_text(text: Column) -> Column:
    """Number, from 1, of the first line that is not blank; 0 without one."""
    return F.array_position(F.transform(split_lines(text), lambda line: ~rx.is_blank(line)), True)


def count_lines_with_text(text: Column) -> Column:
    return F.size(F.filter(split_lines(text), lambda line: ~rx.is_blank(line)))


def halves(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Each group's rows in two halves; the first has the odd row."""
    return rows.withColumn("half", F.ntile(2).over(Window.partitionBy(*by).orderBy(*order)))


def lines_with_several_ids(text: Column) -> Column:
    """Numbers, among the lines with text, of lines that hold two or more fragment ids."""
    kept = F.filter(split_lines(text), lambda line: ~rx.is_blank(line))
    marked = F.transform(kept, lambda line, i: F.when(F.regexp_count(line, F.lit("\\d{2,5}-\\d+\\|")) >= 2, i + 1))
    return F.filter(marked, lambda n: n.isNotNull())


def restore_from(texts: DataFrame, originals: DataFrame, top: int, key: str = "doc_id") -> DataFrame:
    """The old lines above ``top`` (from 0), the new ones from there on."""
    joined = texts.join(originals.select(key, F.col("text").alias("_new")), key)
    old, new = split_lines(F.col("text")), split_lines(F.col("_new"))
    at = F.least(F.lit(top), F.size(old), F.size(new))
    merged = F.concat(F.slice(old, F.lit(1), at), F.slice(new, at + 1, F.greatest(F.size(new) - at, F.lit(0))))
    return joined.select(key, F.array_join(merged, "\n").alias("text"))


def restore_range(texts: DataFrame, originals: DataFrame, first: tuple[int, int], last: tuple[int, int], key: str = "doc_id") -> DataFrame:
    """(key, text): the original text from one (line, column) to another, both from 0 and clamped to it."""
    joined = texts.join(originals.select(key, F.col("text").alias("_old")), key)
    old = split_lines(F.col("_old"))

    def offset(place: tuple[int, int]) -> Column:
        line = F.least(F.lit(place[0]), F.size(old) - 1)
        before = F.aggregate(F.slice(old, F.lit(1), line), F.lit(0), lambda n, x: n + F.length(x) + 1)
        return before + F.least(F.lit(place[1]), F.length(F.get(old, line)))

    start = offset(first)
    return joined.select(key, F.substring(F.col("_old"), start + 1, F.greatest(offset(last) - start, F.lit(0))).alias("text"))
