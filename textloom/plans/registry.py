"""Named queries over the test tables, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import cases, chains, numbers, texts, vocabularies
from textloom.plans.catalog import Query

CATALOG: dict[str, Query] = {**texts.QUERIES, **vocabularies.QUERIES, **numbers.QUERIES, **chains.QUERIES, **cases.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the documents' words by the vocabulary."""
    return CATALOG["oov_coverage"].run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOG.items() if q.sql}
