"""Operators 1 and 9: held-out accuracy, brute-force dot products, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import quality_classifier, quality_rules
from pyspark.sql import functions as F
from textloom.llm.linear import Features, Model, calibrate, fit, labelled_sample, rows_of


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = docs.merge(labels, on="doc_id").sort_values("doc_id").reset_index(drop=True)
    return both[both.index % 4 != 0], both[both.index % 4 == 0]


@pytest.mark.parametrize("features", [quality_classifier.FEATURES, quality_rules.FEATURES])
def test_held_out_accuracy(split, features):
    train, held = split
    model = fit(rows_of(features, pa.array(train.text)), train.quality.to_numpy(float), features)
    p = model.probabilities(pa.array(held.text))
    right = (p >= 0.5) == (held.quality.to_numpy() == 1)
    assert right.mean() >= 0.93
    assert (p[held.quality.to_numpy() == 1] >= 0.5).mean() >= 0.97


def test_score_is_the_sparse_dot_product():
    f = Features(bits=10, word_orders=(1, 2))
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=1 << 10).astype(np.float32), 0.25, f)
    texts = ["one two two three!!", "", "one", "été — straße ### é"]
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got):
        buckets = [b for part, _ in f.of(pa.array([text])) for b in part.tolist()]
        want = 0.25 + sum(float(model.weights[b]) for b in buckets) / math.sqrt(max(1, len(buckets)))
        assert score == pytest.approx(want, abs=1e-5)


def test_a_row_scores_the_same_in_any_batch():
    f = quality_rules.FEATURES
    model = Model(np.random.default_rng(2).normal(size=1 << f.bits).astype(np.float32), 0.0, f)
    texts = ["some words here", "b", "", "long " * 200_000, "some words here"]
    alone = [model.scores(pa.array([t]))[0] for t in texts]
    assert np.allclose(model.scores(pa.array(texts)), alone, atol=1e-6)


def test_ftrl_matches_a_plain_implementation():
    rng = np.random.default_rng(3)
    f = Features(bits=6)
    rows = [(np.sort(rng.choice(64, 5, replace=False)).astype(np.int32), rng.random(5)) for _ in range(30)]
    y = (rng.random(30) > 0.4).astype(float)
    model = fit(rows, y, f, alpha=0.2, beta=1.0, l1=0.05, l2=0.5, epochs=2)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.2 + 0.5)

    for _ in range(2):
        for (idx, val), label in zip(rows, y):
            items = [*zip(idx.tolist(), val.tolist()), (64, 1.0)]
            w = {i: weight(i) for i, _ in items}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in items)))
            for i, v in items:
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(model.weights, [weight(i) for i in range(64)], atol=1e-5)
    assert model.bias == pytest.approx(weight(64))


def test_calibration_moves_scores_to_frequencies():
    rng = np.random.default_rng(4)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2.5 * s - 1)))).astype(float)
    a, b = calibrate(s, y)
    assert a == pytest.approx(2.5, abs=0.3) and b == pytest.approx(-1, abs=0.2)
    assert calibrate(s, np.ones(4000)) == (1.0, 0.0)


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & M64
    return x ^ x >> 32


def plain_buckets(text, f):
    """Buckets of a text by loops over its characters, with no array and no part of the library."""
    kinds = "(?:[A-Za-z0-9]|[^\\x00-\\x7f])+|[^A-Za-z0-9\\x00-\\x20\\x7f-\U0010ffff]+"
    tokens = re.findall(kinds, text)

    def token_hash(token):
        data = token.encode()
        return plain_mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data)) + len(data)) & M64)

    h = [token_hash(t) for t in tokens]
    out = []
    for n in f.word_orders:
        for i in range(len(h) - n + 1):
            out.append(plain_mix((n + sum(h[i + k] * pow(0xC2B2AE3D27D4EB4F, 2 * k + 1, 1 << 64) for k in range(n))) & M64))
    for lag in f.repeats:
        out += [plain_mix(1000 + lag) for i in range(lag, len(tokens)) if tokens[i] == tokens[i - lag]]
    for n in f.char_orders:
        for i in range(len(text) - n + 1):
            total = 0x51ED270B * n
            for c in text[i : i + n]:
                total = (total * 0x9E3779B97F4A7C15 + ord(c) + 7) & M64
            total ^= total >> 31
            out.append(total * 0xD6E8FEB86659FD93 & M64)
    return [x >> (64 - f.bits) for x in out]


ODD_TEXTS = ["one two two three!!", "", "go go go go", "Es. Es. Es.", "été — straße ### é", "a", "tab\tand\nline 文字 x\u007fy", "same same but same"]


@pytest.mark.parametrize("features", [quality_classifier.FEATURES, quality_rules.FEATURES])
def test_buckets_match_plain_loops(features):
    for text in ODD_TEXTS:
        got = sorted(b for part, _ in features.of(pa.array([text])) for b in part.tolist())
        assert got == sorted(plain_buckets(text, features)), text


def test_probabilities_end_to_end(spark):
    """From labelled rows to calibrated probabilities, by plain loops."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(60):
        good = k % 2
        rows.append((k, " ".join(rng.choice(words[:20] if good else words[10:], 12)), good))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    f = Features(bits=12, word_orders=(1, 2), char_orders=(3,))
    model = quality_rules.rules_model(docs, labels, features=f)
    got = {r["doc_id"]: r["probability"] for r in quality_rules.apply_rules(docs, labels, model=model).collect()}
    order = [r["doc_id"] for r in labelled_sample(docs, labels, "quality", 4000).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").collect()]
    value = {}
    for k, text, _ in rows:
        counts = Counter(plain_buckets(text, f))
        value[k] = {b: n / math.sqrt(sum(counts.values())) for b, n in counts.items()}
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.5

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def score(k):
        return sum(weight(i) * v for i, v in [*value[k].items(), ("bias", 1.0)])

    held = [k for i, k in enumerate(order) if i % 5 == 4]
    for _ in range(5):
        for k in order:
            if k in held:
                continue
            p = 1 / (1 + math.exp(-score(k)))
            now = {i: weight(i) for i in [*value[k], "bias"]}
            for i, v in [*value[k].items(), ("bias", 1.0)]:
                g = (p - rows[k][2]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
    a, b = calibrate(np.array([score(k) for k in held]), np.array([float(rows[k][2]) for k in held]))
    for k, *_ in rows:
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(a * score(k) + b))), abs=1e-4)


def test_classifier_on_odd_rows(spark, odd, empty, labels, documents):
    model = quality_classifier.quality_model(documents, labels)
    out = quality_classifier.classify(odd, labels, model=model).toPandas()
    assert list(out.columns) == ["doc_id", "probability", "accepted"] and len(out) == odd.count()
    assert not out[out.doc_id.isin([2, 3, 4])].accepted.any()
    assert out[out.doc_id == 1].probability.nunique() == 1
    kept = quality_classifier.keep_good(odd, labels, model=model)
    assert kept.columns == odd.columns
    assert quality_classifier.keep_good(empty, labels, model=model).count() == 0


def test_without_labels_everything_with_text_passes(spark, documents, labels):
    none = labels.limit(0)
    out = quality_classifier.classify(documents, none).toPandas()
    assert (out.probability == 0.5).all() and out.accepted.all()


def test_conflicting_and_null_labels(spark):
    docs = spark.createDataFrame([(1, "good text"), (2, "bad text"), (3, "unclear")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 0), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["y"] for r in labelled_sample(docs, labels, "quality", 10).collect()}
    assert got == {1: 1, 2: 0}


def test_rules_on_odd_rows(spark, odd, empty, labels, documents):
    model = quality_rules.rules_model(documents, labels)
    out = quality_rules.apply_rules(odd, labels, model=model).toPandas()
    blank = out[out.doc_id.isin([2, 3, 4])]
    assert blank.probability.isna().all() and (blank.decision == "reject").all()
    p = out.probability
    assert (out.decision[p >= quality_rules.KEEP_FROM] == "keep").all()
    assert (out.decision[(p >= quality_rules.REJECT_BELOW) & (p < quality_rules.KEEP_FROM)] == "review").all()
    assert quality_rules.apply_rules(empty, labels, model=model).count() == 0


def test_repeated_ids_dont_swell_the_sample(spark):
    docs = spark.range(500).selectExpr("IF(id < 400, 1, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows = labelled_sample(docs, labels, "quality", 50).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 50
