"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

The stop-word rule asks for function words of the languages in STOP_WORDS, so it rejects
texts in all others; give ``rules`` without it, or words of more languages, for those.

Cases: a null or empty text has no words and fails. Repeated rows are judged alike. An
empty table gives no rows. Columns other than doc_id and text are ignored by the report;
``keep`` returns the columns it was given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
#: The commonest function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this an at from or "
    "der die und das den von zu mit ist des im für auf ein eine nicht sich dem als "
    "de la le les et des en un une du que est pour dans qui sur par pas au avec "
    "el los las y por con para se del una su lo es no al"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the range in which a text passes; None leaves a side open."""

    measure: str
    least: float | None
    most: float | None


#: The rules besides the base ones. Ranges are wide: they take out boilerplate, shouting, symbol noise and tables, not style.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("marks_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.5),
)
LEAST_WORDS = 50
REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times within an expression."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are hashed and sorted with their places; equal neighbours are repeats. The
    union of the marked windows is summed from the gaps between their starts.
    """

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.zip_with(F.slice(starts, 1, n - 1), F.slice(starts, 2, n - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(n > 0, F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap)).otherwise(0)

    def marked(ranked: Column) -> Column:
        twice = F.filter(
            ranked,
            lambda x, j: ((j > 0) & (F.get(ranked, j - 1)["h"] == x["h"])).eqNullSafe(True) | (F.get(ranked, j + 1)["h"] == x["h"]).eqNullSafe(True),
        )
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def ranked(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Most texts repeat no window; they need no sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, marked))

    def hashed(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, let(windows, ranked)).otherwise(0)

    return let(words, hashed)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1), lambda w: w != "")


def _count(text: Column, characters: str) -> Column:
    """How often some characters occur; texts without any cost a search only."""
    pattern = "[" + characters.replace("|", "\\|") + "]"
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(0).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The counts behind the rules, as columns over a text and its words; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_marks": _count(text, "!?"),
        "n_letters": F.length(F.regexp_replace(text, "[^A-Za-z]+", "")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    """The measures that the threshold table names, over the counts."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "upper_ratio": per("n_upper", "n_letters"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds."""
    known, passed = ratios(), F.lit(True)
    for rule in rules:
        value = known[rule.measure]
        if rule.least is not None:
            passed = passed & (value >= rule.least)
        if rule.most is not None:
            passed = passed & (value <= rule.most)
    return passed


def _counted(docs: DataFrame, kept: Column) -> DataFrame:
    """A kept column and the counts; the words are cut once."""
    cut = docs.select(kept, F.col("text").alias("_text"), _words(F.col("text")).alias("_words"))
    return cut.select(cut.columns[0], *(c.alias(k) for k, c in measures(F.col("_text"), F.col("_words")).items()))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: counts, whether a base rule failed, and the verdict."""
    return _counted(docs, F.col("doc_id")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _base_failed().alias("base_failed"), (~_base_failed() & verdict(rules)).alias("kept"), "n_stop_words", "n_upper",
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    whole = F.struct(*tables.columns(docs)).alias("_row")
    return _counted(docs, whole).filter(~_base_failed() & verdict(rules)).select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(tables.read(spark, sf_dir, "documents"))


def _sql_words() -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM t),
s AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM p, unnest(range(1, len(w) - 1)) AS r(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s) WHERE n > 1),
c AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + k AS j FROM r, unnest([0, 1, 2]) AS u(k)) GROUP BY doc_id),
q AS (
  SELECT p.doc_id,
    len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    len(list_filter(w, lambda x: lower(x) IN ({_sql_words()})))::BIGINT AS n_stop_words
  FROM p LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed
    AND word_chars / n_words BETWEEN 2.0 AND 15.0
    AND n_symbols / n_words <= 0.25
    AND n_marks / n_words <= 0.5
    AND n_stop_words / n_words >= 0.02
    AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5
    AND coalesce(n_upper / nullif(n_letters, 0), 0) <= 0.5) AS kept,
  n_stop_words, n_upper
FROM f
"""
