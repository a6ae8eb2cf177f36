"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdtape.llm import mixing, near_copies, piece_dropout, quality_ledger, radix_dedup
from crowdtape.llm.common import renamed, restored, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule of the full policy."""
    df, to = renamed(docs)
    led = quality_ledger.ledger(df, to["text"])
    return restored(led.filter(quality_ledger.keeps(quality_ledger.FULL)), to)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return radix_dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id."""
    return near_copies.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, under seeded merge-dropout."""
    return piece_dropout.encoded(docs, piece_dropout.model_file(), keep=["doc_id", "source"])


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokens", tokens),
]

#: Weighted sampling and merge-dropout have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
