"""Glossaries of any size, as tables: all terms found in one pass over a text, the longest at each place first.

A glossary is cut into shards of bounded size (one, unless it is over ``SHARD_BYTES``); a
shard becomes an automaton in every task. A pass notes the longest term of its shard at
each place; the last one goes from left to right, takes what stands at a place and jumps
behind it. Work follows the text and the terms that end at one place, not the number of
terms. Of several shards, each is a pass of its own over the written result of the one before.

Terms are matched within lines. An empty term, and one with a line break, is left out; of
entries with equal terms the greatest translation counts, a null one is empty. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.scalar import BORDER, WIDE_SPACE
from linewright.sources import shared

SHARD_BYTES = 32 << 20
_BORDERS = BORDER.strip("[]")
_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
Hit = tuple[int, int, str]


def _automaton(pairs: list[tuple[str, str]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, value in pairs:
        made.add_word(key, (len(key), value))
    made.make_automaton()
    return made


def _longest(text: str, made: ahocorasick.Automaton, known: dict[int, tuple[int, str]]) -> None:
    """Add to (end, value) by start the terms that are longer than those known."""
    for last, (n, value) in made.iter(text):
        start = last + 1 - n
        if start not in known or known[start][0] <= last:
            known[start] = last + 1, value


def _jumps(known: dict[int, tuple[int, str]]) -> Iterator[Hit]:
    at = 0
    for start in sorted(known):
        if start >= at:
            at, value = known[start]
            yield start, at, value


def _padded(text: str, hits: Iterator[Hit]) -> str:
    """Values in place of terms; shorter ones are padded where a border follows on their line."""
    out, at, line_end, border = [], 0, -1, -1
    for start, end, value in hits:
        if end > line_end:
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
            border = max(text.rfind(b, end, line_end) for b in _BORDERS)
        out += [text[at:start], value, WIDE_SPACE * (end - start - len(value)) if border >= end else ""]
        at = end
    return "".join([*out, text[at:]])


def _reversed(text: str, hits: Iterator[Hit]) -> str:
    """Keys in place of values; of the full-width spaces behind a value as many go as the key is longer."""
    out, at = [], 0
    for start, end, key in hits:
        if start < at:  # a value of full-width spaces, eaten already
            continue
        after = end
        while text[after : after + 1] == WIDE_SPACE:
            after += 1
        out += [text[at:start], key, WIDE_SPACE * (after - end - max(0, len(key) - (end - start)))]
        at = after
    return "".join([*out, text[at:]])


def _passed(docs: DataFrame, text: str, shards: list[DataFrame], rebuild: Callable[[str, Iterator[Hit]], str]) -> DataFrame:
    spark, columns = docs.sparkSession, docs.columns
    found = "_found"
    while found in columns:
        found += "_"
    rows = docs
    for number, shard in enumerate(shards):
        pairs = spark.sparkContext.broadcast([tuple(r) for r in shard.collect()])  # a shard is bounded
        first, last = number == 0, number == len(shards) - 1

        def step(batches: Iterator[pa.RecordBatch], pairs=pairs, first=first, last=last) -> Iterator[pa.RecordBatch]:
            made = _automaton(pairs.value)
            for batch in batches:
                place = batch.schema.get_field_index(text)
                kept = batch.columns if first else batch.columns[:-1]
                texts = batch.column(place).to_pylist()
                known: list[dict] = [{} for _ in texts] if first else [{h["start"]: (h["end"], h["value"]) for h in hits or []} for hits in batch.column(len(kept)).to_pylist()]
                if len(made):
                    for t, k in zip(texts, known, strict=True):
                        if t:
                            _longest(t, made, k)
                if last:
                    new = [t if not k else rebuild(t, _jumps(k)) for t, k in zip(texts, known, strict=True)]
                    kept[place] = pa.array(new, batch.schema.field(place).type)
                    yield pa.RecordBatch.from_arrays(kept, names=columns)
                else:
                    hits = [[{"start": s, "end": e, "value": v} for s, (e, v) in k.items()] for k in known]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, _ARROW)], names=[*columns, found])

        kind = docs.schema if last else T.StructType([*docs.schema.fields, T.StructField(found, _FOUND)])
        rows = rows.mapInArrow(step, kind)
        if not last:
            rows = shared.written(rows, "terms")
    return rows


def _replaced(docs: DataFrame, terms: DataFrame, key: str, value: str, text: str, rebuild, most: int) -> DataFrame:
    rows = terms.select(F.col(key).alias("k"), F.coalesce(F.col(value), F.lit("")).alias("v")).filter("k <> '' AND NOT contains(k, '\\n')")
    rows = rows.groupBy("k").agg(F.max("v").alias("v"))
    size = rows.agg(F.sum(F.octet_length("k") + F.octet_length("v") + 32)).first()[0] or 0
    n = max(1, -(-size // most))
    rows = rows if n == 1 else shared.written(rows, "glossary")
    shard = F.pmod(F.xxhash64("k"), F.lit(n))
    return _passed(docs, text, [rows.filter(shard == i) if n > 1 else rows for i in range(n)], rebuild)


def apply(docs: DataFrame, terms: DataFrame, text: str = "text", most: int = SHARD_BYTES) -> DataFrame:
    """docs with all terms of (key, value) replaced in one pass, as ``glossary.apply`` does with a few."""
    return _replaced(docs, terms, "key", "value", text, _padded, most)


def reverse(docs: DataFrame, originals: DataFrame, text: str = "text", most: int = SHARD_BYTES) -> DataFrame:
    """docs with values put back to their keys, as ``glossary.reverse`` does with a few; (value, key) as ``reverse_map`` gives them."""
    return _replaced(docs, originals.filter("key <> ''"), "value", "key", text, _reversed, most)
