"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, mixing, near_dedup, quality_classifier, token_binary
from textloom.llm.common import DOCUMENT_COLUMNS, need, saved, table
from textloom.session import spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(need(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their sources' target weights, shuffled."""
    return mixing.mix(docs, with_copy=False)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files of the mixed corpus."""
    return token_binary.write_tokens(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: Neither training nor MinHash nor BPE can be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
