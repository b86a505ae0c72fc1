"""Operator 2 against all-pairs Jaccard similarity."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import near_dedup


def exact_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
        n = min(near_dedup.SHINGLE, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def test_sketch_estimates_follow_jaccard():
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(edited(rng, base, s)) for s in (0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3)]
    minima, has = near_dedup.signatures(pa.array(texts))
    assert has.tolist() == list(range(len(texts)))
    sketches = near_dedup.odd_sketches(minima)
    sets = exact_sets(texts)
    for k in range(1, len(texts)):
        got = near_dedup.similarity(sketches[0], sketches[k])
        assert got == pytest.approx(jaccard(sets[0], sets[k]), abs=0.13)
    assert near_dedup.similarity(sketches[0], sketches[0]) == 1.0


def test_odd_sketch_is_the_parity_of_samples():
    minima = np.array([[5] * near_dedup.K, list(range(near_dedup.K))], np.uint32)
    for row, sketch in zip(minima, near_dedup.odd_sketches(minima)):
        from textloom.llm.kit import U64, mix

        bits = np.zeros(near_dedup.BITS, int)
        for k, m in enumerate(row):
            bits[int(mix(np.array([int(m) + (k << 32)], U64))[0]) % near_dedup.BITS] ^= 1
        assert bits.tolist() == np.unpackbits(sketch.view(np.uint8), bitorder="little").tolist()


def brute_components(sets, threshold):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard(sets[i], sets[j]) >= threshold:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_groups_match_all_pairs(spark):
    rng = random.Random(6)
    texts, truth = [], []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))]
        for c in range(rng.choice([1, 1, 2, 5, 12])):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.05]) if c else 0)))
            truth.append(g)
    docs = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = near_dedup.classes(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [i * 10 for i in range(len(texts))]
    group = {r["doc_id"]: r["class_id"] for r in rows}
    for c in set(group.values()):
        assert c == min(x for x in group if group[x] == c)
    size = Counter(group.values())
    assert all((r["links"] > 0) == (size[r["class_id"]] > 1) for r in rows)
    sets = exact_sets(texts)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= near_dedup.THRESHOLD]
    found = sum(group[i * 10] == group[j * 10] for i, j in pairs)
    assert found >= 0.95 * len(pairs)
    wrong = sum(group[i * 10] == group[j * 10] and truth[i] != truth[j] for i, j in itertools.combinations(range(len(texts)), 2))
    assert wrong == 0


def test_real_documents(spark, documents):
    group = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents).collect()}
    docs = documents.orderBy("doc_id").collect()
    sets = exact_sets([d["text"] for d in docs])
    ids = [d["doc_id"] for d in docs]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if jaccard(sets[i], sets[j]) >= near_dedup.THRESHOLD]
    assert pairs and sum(group[ids[i]] == group[ids[j]] for i, j in pairs) >= 0.9 * len(pairs)
    want = brute_components(sets, 0.3)
    for a, b in itertools.combinations(range(len(ids)), 2):
        if group[ids[a]] == group[ids[b]]:
            assert want[a] == want[b]


def unions(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    return [[find(i) == find(j) for j in range(n)] for i in range(n)]


def chained(n, seed):
    """Sketches of a chain: each differs from the next a little, ends differ a lot."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 32, near_dedup.K, dtype=np.uint32)
    rows = []
    for step in range(n):
        if step:
            base = base.copy()
            at = rng.choice(near_dedup.K, 22, replace=False)
            base[at] = rng.integers(0, 1 << 32, 22, dtype=np.uint32)
        rows.append(base)
    return near_dedup.odd_sketches(np.array(rows))


def test_class_links_join_whatever_is_similar():
    n, most = 12, near_dedup.most_odd(0.5)
    sketch = chained(n, 7)
    near = [(i, j) for i, j in itertools.combinations(range(n), 2) if near_dedup.similarity(sketch[i], sketch[j]) >= 0.5]
    rng = np.random.default_rng(8)
    for _ in range(50):
        order = rng.permutation(n)
        group = np.sort(rng.integers(0, 5, n))  # rows come sorted by class
        same = [(i, j) for i, j in itertools.combinations(range(n), 2) if group[i] == group[j]]
        node = order.astype(np.int64)
        found = near_dedup.class_links(node, group, np.zeros(n, bool), sketch[order], most)
        place = {int(x): k for k, x in enumerate(order)}
        got = unions(n, same + [(place[a], place[b]) for a, b, *_ in found])
        assert got == unions(n, same + [(place[i], place[j]) for i, j in near])
        assert all(group[place[a]] == x and group[place[b]] == y for a, b, x, y in found)


def test_most_odd_is_the_threshold():
    for t in (0.3, 0.5, 0.8, 1.0):
        most = near_dedup.most_odd(t)
        bits = np.zeros((2, near_dedup.BITS), np.uint8)
        for odd in (most, most + 1):
            bits[1] = np.arange(near_dedup.BITS) < odd
            a, b = np.packbits(bits, 1, bitorder="little").view(np.uint64)
            assert (near_dedup.similarity(a, b) >= t) == (odd == most)


def test_block_pairs_hold_every_pair_of_two_classes(spark):
    """Buckets over the limit: every pair of nodes of different classes meets in one row group, and none is large."""
    rng = random.Random(9)
    rows = []
    for band, sizes in {1: [70, 3, 2, 1, 1], 2: [1] * 40, 3: [2, 1], 4: [30, 25, 1], 5: [30, 30]}.items():
        nodes = [(band, sum(sizes), 1000 * band + 100 * c, c) for c, m in enumerate(sizes) for _ in range(m)]
        rows += [(b, n, x + i, 1000 * band + 100 * c) for i, (b, n, x, c) in enumerate(nodes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "band long, n long, node long, root long")
    units = {}
    for r in near_dedup.block_pairs(df, 8).collect():
        units.setdefault((r["band"], r["low"], r["high"]), []).append((r["node"], r["root"], r["block"]))
    met = Counter()
    for (band, low, high), nodes in units.items():
        assert len(nodes) <= 50
        for (x, cx, bx), (y, cy, by) in itertools.combinations(nodes, 2):
            if cx != cy and (low == high or bx != by):
                met[frozenset((x, y))] += 1
    want = {frozenset((x[2], y[2])) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[3] != y[3]}
    assert set(met) == want and set(met.values()) == {1}


def test_groups_alike_with_buckets_cut_to_blocks(spark, monkeypatch):
    """Near-copies of few texts, in buckets over the limit, against whole buckets."""
    rng = random.Random(10)
    texts = []
    shared = [f"s{k}" for k in range(60)]
    for _ in range(6):
        base = shared + [f"w{rng.randrange(3000)}" for _ in range(30)]
        texts += [" ".join(edited(rng, base, rng.choice([0.02, 0.05, 0.1]))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, node, _ = near_dedup.with_node(docs)

    def groups(hot):
        labels, _ = near_dedup.group_labels(rows, node, hot=hot)
        return sorted((r["node"], r["root"]) for r in labels.collect())

    assert groups(5) == groups(2048)


def test_thousands_of_copies_make_one_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text again and again in every row' AS text")
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == 3000 and {r["class_id"] for r in rows} == {0}
    assert {r["links"] for r in rows if r["doc_id"]} == {1} and [r["links"] for r in rows if not r["doc_id"]] == [2999]


def test_ids_of_any_type(spark):
    text = "one text of several words that occurs twice here"
    docs = spark.createDataFrame([("b", text), ("a", text), ("c", "another text")], "doc_id string, text string").coalesce(1)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got["a"] == got["b"] and got["c"] == "c"
    assert near_dedup.keep_one(docs).count() == 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_odd_rows(spark, odd, empty):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 1  # the repeated row
    assert len(rows) == odd.count() - 1  # texts without words stay
    assert near_dedup.keep_one(empty).count() == 0
    assert near_dedup.classes(empty).count() == 0


def test_dropped_ids_join_alike_with_and_without_broadcast(spark, documents, monkeypatch):
    small = sorted(r["doc_id"] for r in near_dedup.keep_one(documents).collect())
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 0)
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(documents).collect()) == small
