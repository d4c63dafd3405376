"""Translations joined back onto the lines that their fragments came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import rewriting, rx, scalar
from linewright.operators import extract, glossary
from linewright.sources import html


def parse_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, line) in wire format as (doc_id, frag_id, text), the last row of an id winning."""
    at = F.instr("line", "|")
    split = rows.filter(at > 0).select(
        "doc_id", "pos", rx.strip(F.substring(F.col("line"), F.lit(1), at - 1)).alias("frag_id"), rx.strip(F.substring(F.col("line"), at + 1, F.length("line"))).alias("text")
    )
    return split.groupBy("doc_id", "frag_id").agg(F.max_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def pairs(extracted: DataFrame, translated: DataFrame) -> DataFrame:
    """Fragments with their translations: (doc_id, frag_id, pos, original, translation)."""
    left = extracted.select("doc_id", "frag_id", F.col("text").alias("original"))
    right = translated.select("doc_id", "frag_id", "pos", F.col("text").alias("translation"))
    return left.join(right, ["doc_id", "frag_id"])


def coverage(extracted: DataFrame, translated: DataFrame) -> DataFrame:
    """Per document the share of fragment ids that are translated, and whether it is under a half."""
    ids = extracted.select("doc_id", "frag_id").distinct()
    known = translated.select("doc_id", "frag_id", F.lit(1).alias("_known")).distinct()
    counted = ids.join(known, ["doc_id", "frag_id"], "left").groupBy("doc_id").agg(F.count("*").alias("n_ids"), F.count("_known").alias("n_translated"))
    ratio = F.col("n_translated") / F.col("n_ids")
    return counted.select("doc_id", "n_ids", "n_translated", ratio.alias("coverage"), (ratio < 0.5).alias("is_low"))


def _edit(line_no: Column, pos: Column, original: Column, translation: Column) -> Column:
    """(line_no, pos, a, b); line 0 where none is named, and what has no position comes first."""
    pos = F.coalesce(pos.cast("bigint"), F.lit(-(1 << 63)))
    return F.struct(F.coalesce(line_no, F.lit(0)).alias("line_no"), pos.alias("pos"), original.alias("a"), translation.alias("b"))


def _in_terms(translation: Column, terms: dict[str, str]) -> Column:
    for key in sorted(terms, key=len, reverse=True):
        translation = F.replace(translation, F.lit(key), F.lit(terms[key]))
    return translation


def _edited(text: Column, edits: Column) -> Column:
    """A text rewritten; texts without edits do not go through Python."""
    edits = F.filter(edits, lambda e: (e["a"] != "") & e["b"].isNotNull())
    return F.coalesce(rewriting.rewrite(F.when(F.size(edits) > 0, text), edits), text)


def apply(docs: DataFrame, found: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """Documents with translations in place of their fragments.

    ``found`` is what ``pairs`` returns. Terms are replaced in each translation, the
    longest first; of a line's fragments the longest original goes first. Where a border
    follows, a shorter translation is padded with full-width spaces. At the end the terms
    are applied to the whole text. A fragment whose id names no line of the document is
    tried on all its lines; an empty original, or a null translation, is left out.
    """
    terms = {k: v for k, v in (terms or {}).items() if k}
    line_no = F.split_part("frag_id", F.lit("-"), F.lit(1)).try_cast("int")
    edit = _edit(line_no, F.col("pos"), F.col("original"), _in_terms(F.col("translation"), terms))
    edits = found.filter("original <> ''").groupBy("doc_id").agg(F.collect_list(edit).alias("_edits"))
    joined = docs.join(edits, "doc_id", "left").withColumn("text", _edited(F.col("text"), F.col("_edits")))
    return joined.withColumn("text", glossary.apply(F.col("text"), terms)).drop("_edits")


def apply_all(docs: DataFrame, made: Callable[[dict[str, Column]], tuple[Column, Column]], config: extract.Config = extract.Config(), terms: dict[str, str] | None = None) -> DataFrame:
    """As ``apply`` of all fragments of all documents, where a fragment's translation is an expression.

    ``made`` gives the number of a line and the translation of a fragment's seq, line_no, text and sub; where the
    text has no such line, all are tried. What is translated stands beside its text: texts are dealt by doc_id once,
    and fragments are never shuffled, but those of documents that share a doc_id. Documents without a doc_id stay as
    they are, since no fragment names them.
    """
    terms = {k: v for k, v in (terms or {}).items() if k}

    def edit(x: dict[str, Column]) -> Column:
        line_no, translation = made(x)
        return _edit(line_no, x["seq"], x["text"], _in_terms(translation, terms))

    own, shared = extract.beside(docs, edit, "_edits", config)
    done = own.withColumn("text", _edited(F.col("text"), F.when(F.col("doc_id").isNotNull(), F.col("_edits"))))
    done = done.withColumn("text", glossary.apply(F.col("text"), terms)).drop("_edits")
    if shared is None:
        return done
    rows = extract.numbered(shared, config)
    line_no, translation = made({name: F.col(name) for name in ("seq", "line_no", "text", "sub")})
    found = rows.select("doc_id", F.concat_ws("-", line_no, "sub").alias("frag_id"), F.col("seq").alias("pos"), F.col("text").alias("original"), translation.alias("translation"))
    return done.unionByName(apply(shared, found, terms).select(*done.columns))


def prepared(docs: DataFrame, extracted: DataFrame, translated: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """Documents of (doc_id, text, title, number) translated, with their names and how much of them is translated.

    (doc_id, text, source, file_name, display, coverage, is_low); documents without a
    translated fragment, which there is nothing to write of, are left out.
    """
    found = pairs(extracted, translated)
    done = apply(docs.withColumn("source", F.col("text")).join(found.select("doc_id").distinct(), "doc_id", "left_semi"), found, terms)
    named = done.withColumn("_names", scalar.output_names(F.col("title"), F.col("number"))).join(coverage(extracted, translated), "doc_id")
    return named.select("doc_id", "text", "source", "_names.file_name", "_names.display", "coverage", "is_low")


def save(made: DataFrame, path: str, color: str = "#ffffff") -> None:
    """What ``prepared`` gives as one page for each file name, in a shared folder."""
    html.write_folder(made.select("file_name", html.page(F.col("text"), F.lit(color)).alias("value")), path)
