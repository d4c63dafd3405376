"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet
and reads it back as the next stage's docs, so a lost executor repeats one stage at most.
All stages but the last return the columns of documents, whatever their names.

Cases: a null or empty text has no words and goes with the quality rules. Of repeated
rows, and of rows of one class of near duplicates, one stays. Rows with a null doc_id
belong to no class: those of good quality all stay, through decontamination too, their
secrets are masked and they are packed. Very long texts are treated whole. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linewright.llm import decontam, packing, quality, secrets, similarity, tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some rule rejects go."""
    return quality.keep(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return similarity.keep_one(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.keep_clean(spark, docs, tables.read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mask."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", pass_quality_rules),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the tokens; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.cut(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
