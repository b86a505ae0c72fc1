"""The pipeline against its parts, and the guard of the entry."""

import corpus_pipeline
from textloom.llm import decontamination, mixing, near_dedup, quality_classifier, registry
from textloom.llm.common import DOCUMENT_COLUMNS


def test_stages_follow_each_other(spark, sf, documents, labels, benchmark):
    docs = documents
    good = corpus_pipeline.quality(spark, docs, sf)
    accepted = {r["doc_id"] for r in quality_classifier.classify(docs, labels).where("accepted").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted < {r["doc_id"] for r in docs.collect()}
    single = corpus_pipeline.near_duplicates(spark, good, sf)
    assert {r["doc_id"] for r in single.collect()} == {r["class_id"] for r in near_dedup.classes(good).collect()}
    clean = corpus_pipeline.decontaminate(spark, single, sf)
    leaks = {r["doc_id"] for r in decontamination.find_leaks(single, benchmark).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaks
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    assert mixed.columns == DOCUMENT_COLUMNS
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.mix(clean).collect())
    for df in (good, single, clean):
        assert df.columns == DOCUMENT_COLUMNS


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert list(out.columns) == ["doc_id", "part", "start", "n_tokens"] and len(out)
    rows = out.sort_values(["start", "n_tokens"])
    assert (rows.start.to_numpy()[1:] == (rows.start + rows.n_tokens).to_numpy()[:-1]).all()


def test_every_stage_takes_an_empty_table(spark, sf, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, sf, odd):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf).collect()


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)


def test_run_matches_brute_force(spark, sf, documents, labels, benchmark):
    """All five stages by plain loops over the texts, with no part of the operators."""
    import collections
    import itertools
    import math
    import re

    from pyspark.sql import functions as F
    from test_quality import plain_buckets
    from test_sharding_mixing import brute_counts
    from textloom.llm.linear import labelled_sample
    from textloom.llm.tokenizer import DEFAULT_TOKENIZER, PATTERN

    docs = {r["doc_id"]: r for r in documents.collect()}
    # 1: follow-the-regularised-leader over the labelled rows in their seeded order
    f = quality_classifier.FEATURES
    value = {}
    for k, r in docs.items():
        n = collections.Counter(plain_buckets(r["text"], f))
        value[k] = {b: x / math.sqrt(max(1, sum(n.values()))) for b, x in n.items()} | {"bias": 1.0}
    order = labelled_sample(documents, labels, "quality", 4000).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").collect()
    z, n = collections.Counter(), collections.Counter()
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.5

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(5):
        for r in order:
            x = value[r["doc_id"]]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - r["y"]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    good = [k for k in sorted(docs) if docs[k]["text"].strip() and sum(weight(i) * v for i, v in value[k].items()) >= 0]
    assert 0 < len(good) < len(docs)
    # 2: components of all pairs with a Jaccard similarity of a half
    tokens = {k: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", docs[k]["text"].lower()) for k in good}
    sets = {k: {tuple(t[i : i + min(3, len(t))]) for i in range(max(1, len(t) - 2))} if t else set() for k, t in tokens.items()}
    root = {k: k for k in good}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(good, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    single = [k for k in good if find(k) == k]
    assert len(single) < len(good)
    # 3: runs of eight words of a benchmark item
    items = [re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", r["text"].lower()) for r in benchmark.collect()]
    runs = {tuple(t[i : i + 8]) for t in items for i in range(len(t) - 7)}
    clean = [k for k in single if not any(tuple(tokens[k][i : i + 8]) in runs for i in range(len(tokens[k]) - 7))]
    assert len(clean) < len(single)
    # 4: copies by a Poisson quantile
    copies = brute_counts([docs[k] for k in clean], mixing.SEED)
    # 5: the public tokenizer on whole texts
    import base64

    import tiktoken

    with open(DEFAULT_TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = collections.Counter()
    for k in clean:
        want[k, len(encode(docs[k]["text"]))] += copies[str(tuple(docs[k]))]
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
