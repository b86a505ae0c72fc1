"""Queries of the training-text operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    decontamination,
    language_id,
    lm_scoring,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    sharding,
    token_binary,
    token_counts,
)
from textloom.llm.common import table
from textloom.session import shared_path, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sharding.write_shards(table(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_tokens(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_minhash_near_dedup,
            op3_language_id,
            op4_sharding,
            op5_token_binary,
            op6_token_counts,
            op7_decontamination,
            op8_lm_scoring,
            op9_quality_rules,
            op10_mixing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_lm_scoring": lm_scoring.LM_SQL.format(least=lm_scoring.MIN_COUNT), "op10_mixing": mixing.MIX_SQL.format(docs="documents")}
