"""A training-data pipeline of five operators; each stage's decisions take effect on the documents the next one gets.

All stages take documents with any further columns, whose names may clash with theirs but not differ by case only; all but the last return those columns.
Repeated rows stay repeated where a stage says nothing else, and the longest text must fit in a worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafspan.llm import byte_bpe, common, decontaminate, jaccard, quality_model, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged by the model's thresholds alone; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one whose id is least. Null texts, texts without words and rows with a null id stay; rows that
    repeat an id stay or go together; an empty table stays empty."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go. Null texts and texts without words stay, and so do all where the benchmark is empty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows. No row goes; a null text stays null; an empty table stays empty."""
    return secrets.mask_secrets(docs, length_col="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, ready for training. A null text has none; an empty table gives an empty one."""
    return byte_bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("without_secrets", without_secrets), ("encoded", encoded)]

#: The classifier, the join and the encoder are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
