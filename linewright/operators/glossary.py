"""Term glossaries: parsing, merging, applying and reversing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import rx
from linewright.functions.scalar import BORDER, WIDE_SPACE


def decode_term(term: Column) -> Column:
    """Trimmed, unless backticks keep its outer spaces."""
    bare = rx.strip(term)
    wrapped = (F.length(bare) >= 2) & bare.startswith("`") & bare.endswith("`")
    return F.when(wrapped, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def encode_term(term: Column) -> Column:
    """In backticks where trimming would change it."""
    return F.when((term == "") | (term != rx.strip(term)), F.concat(F.lit("`"), term, F.lit("`"))).otherwise(term)


def _expanded(key: Column, value: Column) -> Column:
    """The entries that one line stands for: both sides split at the marker, if it splits them alike."""
    marker = F.regexp_extract(key, "\\\\(.)", 0)
    parts = lambda c: F.transform(F.split(c, rx.quoted(marker), -1), rx.strip)
    pairs = F.transform(F.arrays_zip(parts(key).alias("k"), parts(value).alias("v")), lambda z: F.struct(z["k"].alias("key"), z["v"].alias("value")))
    splits = (marker != "") & (F.size(parts(key)) == F.size(parts(value))) & (F.size(parts(key)) >= 2)
    return F.when(splits, F.filter(pairs, lambda p: p["key"] != "")).otherwise(F.array(F.struct(key.alias("key"), value.alias("value"))))


def entries(lines: DataFrame) -> DataFrame:
    """(pos, key, value) of every entry of (pos, line), in order, later ones not yet overriding."""
    at = F.instr("line", "=")
    rows = lines.filter(at > 0).select("pos", decode_term(F.substring(F.col("line"), F.lit(1), at - 1)).alias("k"), decode_term(F.substring(F.col("line"), at + 1, F.length("line"))).alias("v"))
    rows = rows.filter("k <> ''").select("pos", F.posexplode(_expanded(F.col("k"), F.col("v"))).alias("sub", "e"))
    return rows.select("pos", "sub", "e.key", "e.value").filter("key <> ''")


def parse(lines: DataFrame) -> DataFrame:
    """(key, value), the last entry of a key winning; pos is where the key came first."""
    found = entries(lines)
    return found.groupBy("key").agg(F.min(F.struct("pos", "sub")).alias("_first"), F.max_by("value", F.struct("pos", "sub")).alias("value")).select("_first.pos", "_first.sub", "key", "value")


def duplicates(lines: DataFrame) -> DataFrame:
    """Keys that occur on several lines, with the lines."""
    at = F.instr("line", "=")
    keyed = lines.filter(at > 0).select("pos", decode_term(F.substring(F.col("line"), F.lit(1), at - 1)).alias("key")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("n")).filter("n >= 2")


def reverse_map(pairs: DataFrame) -> DataFrame:
    """For every value the longest key, the first of equals: (value, key)."""
    return pairs.filter("value <> ''").groupBy("value").agg(F.max_by("key", F.struct(F.length("key"), -F.col("pos"))).alias("key"))


def merge(existing: DataFrame, current: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Two glossaries of (pos, line) merged by key; those of each group on their own where ``by`` names columns.

    Existing order stays; a key of both takes its last current line; new keys, then new
    lines without an equals sign, follow in the order in which they first appear.
    """
    at = F.instr("line", "=")
    key = F.when(at > 0, decode_term(F.substring(F.col("line"), F.lit(1), at - 1)))
    old, new = existing.withColumn("key", key), current.withColumn("key", key)
    latest = new.filter("key IS NOT NULL").groupBy(*by, "key").agg(F.max_by("line", "pos").alias("_line"), F.min("pos").alias("_first"))
    kept = old.join(latest, [*by, "key"], "left").select(*by, F.lit(0).alias("part"), "pos", F.coalesce("_line", "line").alias("line"))
    added = latest.join(old, [*by, "key"], "left_anti").select(*by, F.lit(1).alias("part"), F.col("_first").alias("pos"), F.col("_line").alias("line"))
    extra = new.filter("key IS NULL").groupBy(*by, "line").agg(F.min("pos").alias("pos"))
    extra = extra.join(old.filter("key IS NULL"), [*by, "line"], "left_anti").select(*by, F.lit(2).alias("part"), "pos", "line")
    return kept.unionByName(added).unionByName(extra)


def merge_lines(existing: DataFrame, current: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Existing lines, then current ones that are new, each once."""
    added = current.groupBy(*by, "line").agg(F.min("pos").alias("pos")).join(existing, [*by, "line"], "left_anti")
    return existing.select(*by, F.lit(0).alias("part"), "pos", "line").unionByName(added.select(*by, F.lit(1).alias("part"), "pos", "line"))


def _per_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), change), "\n")


def apply(text: Column, terms: dict[str, str]) -> Column:
    """All terms replaced in one pass, the longest first, line by line.

    A shorter value is padded with full-width spaces where a border follows on the line.
    """
    terms = {k: v for k, v in terms.items() if k}
    if not terms:
        return text
    values = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])

    def build(z: Column) -> Column:
        gaps, hits = z["gaps"], z["hits"]
        last = lambda pieces: F.size(pieces) - F.array_position(F.reverse(F.transform(pieces, lambda x: x.rlike(BORDER))), True)
        border = F.greatest(F.when(F.exists(gaps, lambda x: x.rlike(BORDER)), last(gaps)), F.when(F.exists(hits, lambda x: x.rlike(BORDER)), last(hits)), F.lit(-1))

        def rewritten(y: Column) -> Column:
            def piece(hit: Column, i: Column) -> Column:
                value = F.element_at(values, hit)
                pad = F.when(i < y["border"], F.repeat(F.lit(WIDE_SPACE), F.greatest(F.length(hit) - F.length(value), F.lit(0)))).otherwise("")
                return F.concat(value, pad, F.get(y["gaps"], i + 1))

            return F.concat(F.get(y["gaps"], F.lit(0)), F.array_join(F.transform(y["hits"], piece), ""))

        return rx.let(F.struct(gaps.alias("gaps"), hits.alias("hits"), border.alias("border")), rewritten)

    pattern = rx.alternation(terms)

    def changed(line: Column) -> Column:
        both = F.struct(F.split(line, pattern, -1).alias("gaps"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("hits"))
        return F.when(line.rlike(pattern), rx.let(both, build)).otherwise(line)

    return _per_line(text, changed)


def reverse(text: Column, originals: dict[str, str]) -> Column:
    """Values back to their originals; padding that a longer original brought is eaten.

    ``originals`` maps each value to its key, as ``reverse_map`` gives them.
    """
    originals = {k: v for k, v in originals.items() if k}
    if not originals:
        return text
    keys = F.create_map(*[F.lit(x) for pair in originals.items() for x in pair])

    def body(hit: Column, i: Column, gaps: Column, hits: Column) -> Column:
        value = F.regexp_replace(hit, f"{WIDE_SPACE}+$", "")
        key = F.element_at(keys, value)
        spare = F.length(hit) - F.length(value) - F.greatest(F.length(key) - F.length(value), F.lit(0))
        return F.concat(key, F.repeat(F.lit(WIDE_SPACE), F.greatest(spare, F.lit(0))))

    pattern = f"(?:{rx.alternation(originals)}){WIDE_SPACE}*"
    return _per_line(text, lambda line: rx.rewrite(line, pattern, body))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements one after the other: (text, how many)."""
    zero = F.struct(text.alias("text"), F.lit(0).alias("n"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs if a])

    def step(acc: Column, x: Column) -> Column:
        cut = F.replace(acc["text"], x["a"], F.lit(""))
        n = ((F.length(acc["text"]) - F.length(cut)) / F.length(x["a"])).cast("int")
        return F.struct(F.replace(acc["text"], x["a"], x["b"]).alias("text"), (acc["n"] + n).alias("n"))

    return F.aggregate(steps, zero, step)


def numbered(text: Column, frame: DataFrame) -> DataFrame:
    """The lines of a one-row text as (pos, line)."""
    return frame.select(F.posexplode(F.split(text, "\\r\\n|[\\n\\r]", -1)).alias("pos", "line"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the first in order."""
    first = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def combined(normal: Column, temporary: Column) -> Column:
    """Two glossaries as one text, blank ones left out; entries of the second come later, so they win."""
    part = lambda text: F.nullif(rx.strip(text), F.lit(""))
    return F.concat_ws("\n", part(normal), part(temporary))


def with_entry(text: Column, original: Column, translation: Column) -> Column:
    """A glossary with one more entry on a line of its own; unchanged where a side of the entry is empty."""
    bare = F.rtrim(text, F.lit("\n"))
    entry = F.concat(encode_term(original), F.lit("="), encode_term(translation))
    return F.when((original == "") | (translation == ""), text).otherwise(F.concat(F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n"))), entry))


def quick_entries(lines: DataFrame) -> DataFrame:
    """(pos, sub, key, value) of a list of plain replacements: either equals sign parts a line, the first one counts.

    Backticks mean nothing here, and a key may stand several times.
    """
    line = rx.strip(F.col("line"))
    at = F.regexp_instr(line, F.lit("[=＝]"))
    side = lambda s: F.when(at > 0, rx.strip(s))
    rows = lines.select("pos", side(F.substring(line, F.lit(1), at - 1)).alias("k"), side(F.substring(line, at + 1, F.length(line))).alias("v"))
    return rows.filter("k <> ''").select("pos", F.posexplode(_expanded(F.col("k"), F.col("v"))).alias("sub", "e")).select("pos", "sub", "e.key", "e.value")
