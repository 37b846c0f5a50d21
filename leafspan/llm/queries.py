"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, decontaminate, jaccard, pseudonyms, quality_model, quality_rules, repair, secrets, simhash, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is for tests; in production it comes from a secret store."""
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), b"leafspan test key")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit(r"\### Assistant: </turn> ok")
    turn = F.col("id").cast(turns.schema["turn"].dataType)
    more = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), turn.alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), odd.alias("text"))
    return chat.read_back(chat.format_examples(turns.unionByName(more)))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, _table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(_table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_suffix_dedup, op3_secrets, op4_pseudonyms, op5_byte_bpe, op6_quality_model, op7_decontaminate, op8_chat_format, op9_jaccard, op10_quality_rules, op11_alignment, op12_repair, op13_simhash]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
