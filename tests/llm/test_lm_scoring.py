"""Operator 8 against counting in plain Python, and the SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from textloom.llm import lm_scoring as L


def brute(texts, least):
    docs = [re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower()) for t in texts]
    count = Counter(tuple(d[i : i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    total = sum(len(d) for d in docs)
    out = []
    for d in docs:
        score = 0.0
        for i in range(len(d)):
            high = min(i, 2)
            for n in range(high, -1, -1):
                gram = tuple(d[i - n : i + 1])
                if n == 0:
                    score += math.log(count[gram] / total) + high * math.log(L.ALPHA)
                elif count[gram] >= least:
                    score += math.log(count[gram] / count[gram[:-1]]) + (high - n) * math.log(L.ALPHA)
                    break
        out.append((len(d), score))
    return out


def check(rows, docs, least=L.MIN_COUNT):
    want = brute([d["text"] for d in docs], least)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["log_score"]) for r in rows))
    want = sorted((d["doc_id"] is None, d["doc_id"] or 0, n, s) for d, (n, s) in zip(docs, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_match_counting(spark, documents, least):
    check(L.score(documents, min_count=least).collect(), documents.collect(), least)


def test_many_blocks_and_ranges(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "PARTITIONS", 7)
    check(L.score(documents.repartition(5), block_bytes=20_000, range_grams=500).collect(), documents.collect())


def test_no_more_rows_than_ngrams(spark):
    """Ranges without an n-gram of a block make no row."""
    import pyarrow as pa

    rows = pa.table({"doc_id": [1], "text": ["a b c d e f"]})
    batch = pa.RecordBatch.from_pydict({"block": [3], "data": [L._packed(rows)]})
    got = pa.Table.from_batches(L._count(3, 1 << 30)(iter([batch])))
    assert got.num_rows == 6 + 5 + 4
    part = got["part"].to_pylist()
    assert part == sorted(part) and max(part) < 1 << 30


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a1", "one two one two"), ("b-2", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_words"] for r in L.score(docs).collect()}
    assert got == {"a1": 4, "b-2": 0}


def test_odd_rows(spark, odd, empty):
    rows = L.score(odd).collect()
    check(rows, odd.collect())
    for r in rows:
        assert (r["mean_log_score"] is None) == (r["n_words"] == 0)
    assert L.score(empty).count() == 0


@pytest.mark.parametrize("least", [1, 2])
def test_sql(spark, sf, documents, least):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(L.LM_SQL.format(least=least)).df().sort_values("doc_id")
    got = L.score(documents, min_count=least).toPandas().sort_values("doc_id")
    assert got.n_words.tolist() == want.n_words.tolist()
    assert np.allclose(got.log_score, want.log_score, atol=1e-3)


def test_packing_round_trips():
    rng = np.random.default_rng(10)
    for v in (np.zeros(0, np.uint64), np.array([0, 0, 5], np.uint64), rng.integers(0, 1 << 56, 1000, dtype=np.uint64), np.array([2**63], np.uint64)):
        assert L.unpack(L.pack(v)).tolist() == v.tolist()
