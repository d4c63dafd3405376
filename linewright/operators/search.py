"""Search and replace over the lines of a corpus, with offsets, context and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import rx

CONTEXT = 10
MOST = 500


def hits(docs: DataFrame, needle: str, regex: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every non-overlapping match on every line, with offsets from 0 and the text around it.

    (key, line_idx, match_start, match_end, matched_text, ctx_before, ctx_after)
    """
    pattern = needle if regex else rx.quote(needle)
    lines = docs.filter(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_idx", "line"))
    found = lines.filter(F.col("line").rlike(pattern)).select(key, "line_idx", "line", F.explode(rx.matches(F.col("line"), pattern)).alias("m"))
    start, end, line = F.col("m.start"), F.col("m.end"), F.col("line")
    before = F.substring(line, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substring(line, end + 1, F.lit(CONTEXT))
    return found.select(
        key, "line_idx", start.alias("match_start"), end.alias("match_end"), F.col("m.text").alias("matched_text"),
        F.concat(F.when(start > CONTEXT, "…").otherwise(""), before).alias("ctx_before"),
        F.concat(after, F.when(F.length(line) > end + CONTEXT, "…").otherwise("")).alias("ctx_after"),
    )


def first_hits(found: DataFrame, most: int = MOST, key: str = "doc_id") -> DataFrame:
    """The report: at most ``most`` hits, in order of document, line and offset."""
    return found.orderBy(key, "line_idx", "match_start").limit(most)


def counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key).agg(F.count("*").alias("n_hits"), F.countDistinct("line_idx").alias("n_lines"))


def splice(text: Column, edits: Column, value: Column) -> Column:
    """A line with the value in place of each (match_start, match_end), from right to left."""

    def step(acc: Column, e: Column) -> Column:
        return F.overlay(acc, value, e["match_start"] + 1, e["match_end"] - e["match_start"])

    return F.aggregate(F.reverse(F.array_sort(edits)), text, step)


def replace_hits(docs: DataFrame, found: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Documents with the hits replaced by a literal; ``before`` keeps the old text, ``n_replaced`` counts.

    Dismissed hits are simply not in ``found``. All offsets refer to the given text.
    """
    by_line = found.groupBy(key, "line_idx").agg(F.collect_list(F.struct("match_start", "match_end")).alias("edits"))
    by_doc = by_line.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line_idx", "edits"))).alias("_edits"), F.sum(F.size("edits")).alias("_n"))
    joined = docs.join(by_doc, key, "left").withColumn("before", F.col("text"))

    def changed(line: Column, i: Column) -> Column:
        mine = F.try_element_at("_edits", i)
        return F.when(mine.isNull(), line).otherwise(splice(line, mine, F.lit(value)))

    text = F.when(F.col("_edits").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", "\n", -1), changed), "\n"))
    return joined.withColumn("text", text).withColumn("n_replaced", F.coalesce("_n", F.lit(0)).cast("long")).drop("_edits", "_n")


def replace_all(docs: DataFrame, needle: str, value: str, regex: bool = False) -> DataFrame:
    """As ``replace_hits`` with every hit, in one projection: nothing is exploded or joined."""
    pattern = needle if regex else rx.quote(needle)
    lines = F.split("text", "\n", -1)
    changed = F.array_join(F.transform(lines, lambda line: rx.rewrite(line, pattern, lambda *_: F.lit(value))), "\n")
    count = F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.regexp_count(line, F.lit(pattern)))
    hit = F.col("text").rlike(pattern)
    return docs.withColumns({"before": F.col("text"), "n_replaced": F.when(hit, count).otherwise(0), "text": F.when(hit, changed).otherwise(F.col("text"))})


def undo(replaced: DataFrame, only: Column | None = None) -> DataFrame:
    """The texts of before the replacement, of all documents or of some."""
    back = F.lit(True) if only is None else only
    return replaced.withColumn("text", F.when(back, F.col("before")).otherwise(F.col("text"))).withColumn("n_replaced", F.when(back, 0).otherwise(F.col("n_replaced")).cast("long"))


def find_next(text: Column, needle: Column, start: Column) -> Column:
    """Where a literal stands next, in any case, at or behind a place from 0, else from the top on; null where nowhere."""
    held, sought = F.lower(text), F.lower(needle)
    ahead = F.call_function("locate", sought, held, start + 1)
    found = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", sought, held, F.lit(1)))
    return F.when((needle != "") & (found > 0), found - 1)


def replace_one(docs: DataFrame, hit: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Documents with a single hit each replaced by a literal: the first of those given, by line and offset."""
    chosen = hit.groupBy(key).agg(F.min_by(F.struct("line_idx", "match_start", "match_end"), F.struct("line_idx", "match_start")).alias("h"))
    return replace_hits(docs, chosen.select(key, "h.*"), value, key)
