"""Operators 4 and 10."""

import collections
import hashlib
import math

import duckdb
import numpy as np
from textloom.llm import mixing, sharding


def test_fisher_yates_is_the_textbook_algorithm():
    order = sharding.fisher_yates(50, 9, 3)
    draws = np.random.Generator(np.random.PCG64([9, 3])).integers(0, np.arange(50, 1, -1))
    want = list(range(50))
    for k, j in enumerate(draws.tolist()):
        i = 49 - k
        want[i], want[j] = want[j], want[i]
    assert order.tolist() == want
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]


def test_permutations_are_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, s, 0)) for s in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_shards_hold_every_row_once_in_a_seeded_order(spark, documents):
    out = sharding.shard(documents, bucket_bytes=100_000)
    rows = out.toPandas()
    want = documents.toPandas()
    assert sorted(rows.doc_id) == sorted(want.doc_id)
    assert rows.merge(want, on=["doc_id", "text", "lang", "source", "n_chars"]).shape[0] == len(want)
    sizes = rows.groupby("shard").size()
    assert len(sizes) > 3
    for _, g in rows.groupby("shard"):
        assert sorted(g.position) == list(range(len(g)))
    again = sharding.shard(documents.repartition(7), bucket_bytes=100_000).toPandas()
    key = ["shard", "position"]
    assert rows.sort_values(key).doc_id.tolist() == again.sort_values(key).doc_id.tolist()
    other = sharding.shard(documents, seed=1, bucket_bytes=100_000).toPandas()
    assert rows.sort_values(key).doc_id.tolist() != other.sort_values(key).doc_id.tolist()


def test_brute_force_order(spark, documents):
    """Bucket, order by hashes, exchange: the same by hand."""
    from pyspark.sql import functions as F

    out = sharding.shard(documents, bucket_bytes=200_000).toPandas()
    n = out.shard.max() + 1
    cols = [F.col(c) for c in documents.columns]
    hashed = documents.select("doc_id", F.xxhash64(F.lit(sharding.SEED), *cols).alias("h"), F.xxhash64(F.lit(sharding.SEED + 1), *cols).alias("h2")).toPandas()
    hashed["shard"] = hashed.h.map(lambda h: int(h) % int(n))
    for s, g in hashed.sort_values(["h", "h2"]).groupby("shard"):
        want = g.doc_id.to_numpy()[sharding.fisher_yates(len(g), sharding.SEED, int(s))]
        got = out[out.shard == s].sort_values("position").doc_id
        assert got.tolist() == want.tolist()


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "s"), bucket_bytes=300_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count()


def test_sharding_odd_rows(spark, odd, empty):
    out = sharding.shard(odd)
    assert out.columns == [*odd.columns, "shard", "position_"]
    assert sorted(map(str, (r[: len(odd.columns)] for r in out.collect()))) == sorted(map(str, (tuple(r) for r in odd.collect())))
    assert sharding.shard(empty).count() == 0


def test_distribution_is_poisson():
    for rate in (0.01, 0.5, 1.0, 7.3, 60.0, 900.0):
        cdf = mixing.distribution(rate)
        p = np.diff([0.0, *cdf])
        assert abs(sum(k * x for k, x in enumerate(p)) - rate) < 1e-9 * max(1, rate) + 1e-7
        assert 1 - cdf[-1] < 1e-9
    assert mixing.distribution(0) == [1.0]


def brute_counts(rows, seed):
    chars = collections.Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    weight = {s: math.sqrt(c) for s, c in chars.items()}
    whole, total = sum(weight.values()), sum(chars.values())
    out = collections.Counter()
    for r in rows:
        lam = weight[r["source"]] / whole * total / chars[r["source"]] if chars[r["source"]] else 1.0
        word = "null:" + hashlib.md5((r["text"] or "").encode()).hexdigest() if r["doc_id"] is None else str(r["doc_id"])
        u = int(hashlib.md5(f"{seed}:{word}".encode()).hexdigest()[:13], 16) / 2**52
        k, cdf, p = 0, math.exp(-lam), math.exp(-lam)
        while cdf <= u:
            k += 1
            p *= lam / k
            cdf += p
        out[str(tuple(r))] += k
    return +out


def test_mix_matches_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        got = collections.Counter(str(tuple(r)) for r in mixing.mix(docs, with_copy=False).collect())
        assert got == brute_counts(docs.collect(), mixing.SEED)


def test_mix_hits_its_weights(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'some text' AS text", "IF(id % 10 = 0, 'small', 'large') AS source")
    got = mixing.mix(docs, {"small": 0.5, "large": 0.5}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["small"] / 20_000 - 1) < 0.05 and abs(n["large"] / 20_000 - 1) < 0.05
    none = mixing.mix(docs, {"small": 1.0}).groupBy("source").count().collect()
    assert [r["source"] for r in none] == ["small"]


def test_mix_shuffles_globally(spark, documents):
    rows = [r["doc_id"] for r in mixing.mix(documents).collect()]
    n = len(rows)
    later = sum(a < b for a, b in zip(rows, rows[1:])) / n
    assert 0.4 < later < 0.6
    assert rows == [r["doc_id"] for r in mixing.mix(documents).collect()]


def test_mix_sql(spark, sf, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.MIX_SQL.format(docs="documents")).df()
    got = mixing.mix(documents).toPandas()
    key = ["doc_id", "copy"]
    assert got[key].sort_values(key).to_numpy().tolist() == want[key].sort_values(key).to_numpy().tolist()


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0


def test_mix_clashing_names(spark, odd):
    out = mixing.mix(odd.withColumn("copy", odd.doc_id))
    assert out.columns == [*odd.columns, "copy", "copy_"]


def test_query_returns_the_rows_of_written_shards(spark, sf, documents):
    from textloom.llm import registry

    out = registry.op4_sharding(spark, sf)
    files = out.inputFiles()
    assert len(files) == out.select("shard").distinct().count() and not set(files) & set(documents.inputFiles())
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in documents.collect())


def test_shards_alike_in_fewer_partitions(spark, documents, monkeypatch):
    key = ["shard", "position"]
    want = sharding.shard(documents, bucket_bytes=30_000).toPandas().sort_values(key).doc_id.tolist()
    monkeypatch.setattr(sharding, "PARTITIONS", 3)
    out = sharding.shard(documents, bucket_bytes=30_000)
    assert out.rdd.getNumPartitions() == 3
    assert out.toPandas().sort_values(key).doc_id.tolist() == want


def test_mix_alike_without_broadcast(spark, documents, odd, monkeypatch):
    want = [collections.Counter(str(tuple(r)) for r in mixing.mix(d).collect()) for d in (documents, odd)]
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert [collections.Counter(str(tuple(r)) for r in mixing.mix(d).collect()) for d in (documents, odd)] == want


def test_mix_sql_beyond_two_hundred_copies(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 2, 'ab', repeat('abc', 3000)) AS text", "'en' AS lang", "IF(id < 2, 'rare', 'large') AS source", "0L AS n_chars")
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    want = con.execute(mixing.MIX_SQL.format(docs=f"'{tmp_path}/d/*.parquet'")).df()
    got = mixing.mix(docs).toPandas()
    key = ["doc_id", "copy"]
    assert (got.doc_id < 2).sum() > 1000
    assert got[key].sort_values(key).to_numpy().tolist() == want[key].sort_values(key).to_numpy().tolist()


def test_equal_rows_dont_fill_one_bucket(spark):
    """A third of all rows are equal in all columns."""
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    out = sharding.shard(docs, bucket_bytes=3000).toPandas()
    assert sorted(out.doc_id) == sorted(r["doc_id"] for r in docs.collect())
    sizes = out.groupby("shard").size()
    assert len(sizes) > 10 and sizes.max() < 2 * sizes.mean()


def test_rows_of_one_id_spread_over_partitions(spark):
    docs = spark.range(4000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    sizes = mixing.mix(docs).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert 3700 < sum(sizes) < 4300 and max(sizes) < 1.3 * min(sizes)
