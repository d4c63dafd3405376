"""Exact length histogram: token totals, quantiles and truncated totals for every context limit.

Documents are tokenised in a narrow Arrow stage and counted by encoded length with a
partial aggregation, so what is shuffled is one row for each length and task. Suffix
sums run in two levels (within blocks of lengths, then over the blocks), so no window
holds the whole histogram.

Cases: a null or empty text has length 0. Repeated rows count as often as they occur.
An empty table gives no rows. Columns other than text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm import encoding, tables

BLOCK = 256


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.ids(t.as_py())) // 4 for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(measure, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(counts: DataFrame) -> DataFrame:
    """One row for each occurring length L, read as a context limit of L ids.

    docs_over: documents longer than L. tokens_over: their ids. truncated_total: ids kept
    where every document is cut at L. total: all ids. quantile: share of documents of at
    most L ids. The totals of a limit between two lengths follow from the next row above:
    truncated_total(L) = total - tokens_over + L * docs_over.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    held = counts.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = held.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d_after"),
        F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t_after"),
        F.sum("_d").over(every).alias("_docs"),
        F.sum("_t").over(every).alias("total_tokens"),
    )
    above = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.join(blocks, "_block")
    docs_over = F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("_d_after")
    tokens_over = F.coalesce(F.sum("_tokens").over(above), F.lit(0)) + F.col("_t_after")
    rows = rows.withColumn("docs_over", docs_over).withColumn("tokens_over", tokens_over)
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        "total_tokens",
        (1 - F.col("docs_over") / F.col("_docs")).alias("quantile"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    # The histogram is used twice; written once, the documents are encoded once.
    counts = tables.cut(spark, histogram(token_lengths(docs, encoding.default_path())), "lengths")
    return context_limits(counts)
