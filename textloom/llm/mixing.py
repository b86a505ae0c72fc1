"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its
own share.  Each document's number of copies is a Poisson quantile of that mean
at a uniform number hashed from seed and doc_id, so it needs no state and comes
out the same in every run.  Copies are exploded and shuffled globally: a uniform
hash of seed, doc_id, text and copy gives the partition by its range and the order in it,
so rows without an id, or with one id, spread as well.

The quantile comes from the source's cumulative distribution, listed until the
uniform's 52 bits can't reach further: no copy is cut off.  Rates and distributions are
a table with a row a source.  It is written, and broadcast up to a size; beyond, the
documents are joined to it by source, where adaptive plans split a hot source.

Defined results.  A null source is a source of its own.  Sources missing from
given weights have weight 0.  With no weights given, a source's weight is the
square root of its characters, which lifts small sources.  A row without an id is known
by its text.  Repeated rows get equal numbers of copies.  Null and empty texts
have length 0; a source of only such texts has rate 1.  An empty table gives no
row.  Ids may be of any type.  Copies of equal hashes keep no defined order.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textloom.llm.common import fresh, saved, tuned

SEED = "mix-2024"
_BITS = 1 << 52
#: The sources' distributions are broadcast up to this size.
BROADCAST_BYTES = 4 << 20
#: Characters for which the shuffle has a partition, at least.
PARTITION_CHARS = 128 << 20


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from 52 bits of MD5."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(_BITS))


def _identity() -> F.Column:
    """The id, or the text's MD5 where it misses."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))


def distribution(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... while it can be below a 52-bit uniform.

    Terms are exponentials of sums of logarithms, so a large mean doesn't underflow.
    """
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if k > rate and total >= 1 - 1 / _BITS or k > rate + 40 * math.sqrt(rate) + 60:
            return out
        out.append(total)
        k += 1


@F.arrow_udf(ArrayType(DoubleType()))
def _distributions(rate: pa.Array) -> pa.Array:
    return pa.array([distribution(r) for r in rate.to_pylist()], pa.list_(pa.float64()))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> tuple[DataFrame, int]:
    """source, rate: mean copies of a document of each source; and all characters."""
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    own = saved(docs.groupBy("source").agg(F.sum(length).alias("chars")))
    if weights is None:
        own = own.withColumn("weight", F.sqrt(F.col("chars").cast("double")))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        own = own.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total, whole = own.agg(F.sum("chars"), F.sum("weight")).first()
    if not total or not whole:
        return own.select("source", F.lit(1.0).alias("rate")), total or 0
    rate = F.col("weight") / F.lit(float(whole)) * F.lit(float(total)) / F.col("chars")
    return own.select("source", F.when(F.col("chars") == 0, 1.0).otherwise(rate).alias("rate")), total


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, with_copy: bool = True) -> DataFrame:
    """All columns of ``docs``, a row a copy, in a global shuffle; with the copy's number."""
    spark = tuned(docs.sparkSession)
    name, cdf, copy, mark, u = (fresh(docs, n) for n in ("mix_source", "mix_cdf", "copy", "mix_order", "mix_uniform"))
    rate, chars = rates(docs, weights)
    table = saved(rate.select(F.col("source").alias(name), _distributions("rate").alias(cdf)))
    size = table.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 8 * F.size(cdf) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    n = F.size(F.filter(F.col(cdf), lambda p: p <= F.col(u)))
    copies = (
        docs.withColumn(u, uniform(F.lit(seed), _identity()))
        .join(table, F.col("source").eqNullSafe(F.col(name)))
        .withColumn(copy, F.explode(F.sequence(F.lit(0), n)))
        .where(F.col(copy) > 0)
        .withColumn(mark, uniform(F.lit(seed), F.lit("order"), _identity(), F.xxhash64("text").cast("string"), copy))
    )
    kept = [*docs.columns, *([copy] if with_copy else [])]
    # the hash is uniform, so equal ranges of it hold equal shares: no sampling pass is needed
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PARTITION_CHARS))
    return (
        copies.repartitionById(parts, (F.col(mark) * parts).cast("int"))
        .sortWithinPartitions(mark)
        .select(*[F.col(f"`{c}`") for c in kept])
    )


#: A source's counts are listed as far as a 52-bit uniform can reach, however large its rate.
MIX_SQL = """
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM {docs} GROUP BY source),
r AS (SELECT source, CASE WHEN chars = 0 OR sum(chars) OVER () = 0 THEN 1.0
        ELSE sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars END AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, CAST(rate + 40 * sqrt(rate) + 61 AS BIGINT))) AS k FROM r),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT *, CAST('0x' || substr(md5('mix-2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM {docs}),
n AS (SELECT u.u, u.source, count(*) AS n FROM (SELECT DISTINCT u, source FROM u) u
      JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(unnest(range(1, n.n + 1)) AS INTEGER) AS copy
FROM u d JOIN n ON n.u = d.u AND n.source IS NOT DISTINCT FROM d.source
"""
