"""Normalisation of streams: the steps are stateless, so they run on streams as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def normalise_stream(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append the step's rows to Parquet, exactly once, until the files at hand are done."""
    return (
        step(source)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def count_stream(source: DataFrame, column: str, event_time: str, window: str, late: str) -> DataFrame:
    """Words by tumbling window with a watermark, for late rows."""
    from pyspark.sql import functions as F

    words = source.withWatermark(event_time, late).select(event_time, F.explode(F.split(column, r"[ \n]+")).alias("ngram"))
    return (
        words.where("ngram <> ''")
        .groupBy(F.window(event_time, window), "ngram")
        .agg(F.count(F.lit(1)).alias("c"))
        .select(F.col("window.start").alias("start"), "ngram", "c")
    )
