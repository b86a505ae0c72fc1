"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit into a task's
memory, by a seeded hash of their content.  Pass two shuffles each bucket by
Fisher and Yates' exchanges, drawn from a generator seeded by seed and bucket,
and the bucket is written as one shard.  The scatter has at most PARTITIONS partitions:
where there are more buckets, a partition holds several, which its sort, on disk if
need be, sets apart, so that a task holds one bucket at a time and the driver tracks
a bounded number of shuffle blocks.

The order depends on seed, records and number of buckets alone: a bucket is
sorted by its records' hashes before the exchanges, so a task that runs again,
elsewhere or after rows came in another order, yields the same shard.

Rows that are equal in all columns have one hash.  Where there are more of them than a
bucket has rows on average, they are scattered by their place in the input as well, so
that no bucket holds them all; such rows are interchangeable.

Defined results.  Every row comes out exactly once, nulls and repeats included.  An empty table gives no row.  A
text longer than a bucket makes a larger bucket.  Columns that are called shard
or position already keep their names, and ours get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, saved, tuned

BUCKET_BYTES = 64 << 20
PARTITIONS = 20_000
SEED = 2024


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places by n - 1 seeded exchanges."""
    order = list(range(n))
    if n > 1:
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _sizes(docs: DataFrame, mark: Column) -> DataFrame:
    """mark, rows, bytes: all rows by hash, a narrow row for each, copies counted before the shuffle."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(16) for f in docs.schema]
    total = sizes[0].cast("long")
    for s in sizes[1:]:
        total = total + s
    return saved(docs.select(mark.alias("mark"), total.alias("bytes")).groupBy("mark").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")))


def shard(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns, with shard and position in it; a partition holds whole shards."""
    tuned(docs.sparkSession)
    shard_col, place = fresh(docs, "shard"), fresh(docs, "position")
    mark, second, spread = fresh(docs, "order_hash"), fresh(docs, "order_hash_2"), fresh(docs, "order_hash_3")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sizes = _sizes(docs, F.xxhash64(F.lit(seed), *columns))
    total, rows = sizes.agg(F.sum("bytes"), F.sum("rows")).first()
    n = max(1, -(-(total or 0) // bucket_bytes))
    parts = min(n, PARTITIONS)
    marked = docs.withColumns({mark: F.xxhash64(F.lit(seed), *columns), second: F.xxhash64(F.lit(seed + 1), *columns)})
    # of hashes with more than the mean rows of a bucket there are fewer than buckets
    heavy = [r["mark"] for r in sizes.where(F.col("rows") > (rows or 0) / n).select("mark").collect()] if n > 1 else []
    bucket = F.col(mark)
    if heavy:
        many = docs.sparkSession.createDataFrame([(h,) for h in heavy], f"`{spread}` long")
        marked = marked.join(F.broadcast(many), F.col(mark) == F.col(spread), "left")
        bucket = F.when(F.col(spread).isNull(), F.col(mark)).otherwise(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    scattered = (
        marked.withColumn(shard_col, F.pmod(bucket, F.lit(n)).cast("int"))
        .repartitionById(parts, F.floor(F.col(f"`{shard_col}`").cast("long") * parts / n).cast("int"))
        .sortWithinPartitions(shard_col, mark, second)
        .drop(mark, second, spread)
    )

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            order = fisher_yates(rows.num_rows, seed, rows[shard_col][0].as_py())
            for lo in range(0, len(order), 2000):
                part = rows.take(pa.array(order[lo : lo + 2000]))
                part = part.append_column(place, pa.array(np.arange(lo, lo + part.num_rows)))
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            ids = batch[shard_col].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and held[0][shard_col][0].as_py() != int(ids[lo]):
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*scattered.schema.fields]).add(place, LongType())
    return scattered.mapInArrow(exchange, schema)


def write_shards(docs: DataFrame, path: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Parquet files of whole shards, one a file up to PARTITIONS shards, rows in shuffled order."""
    shard(docs, seed, bucket_bytes).write.mode("overwrite").parquet(path)
