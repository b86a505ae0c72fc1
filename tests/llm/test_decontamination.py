"""Operator 7 against exhaustive BM25 and plain word lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import decontamination as D


def tokens(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())


@pytest.fixture(scope="module")
def world():
    rng = random.Random(9)
    common = [f"c{k}" for k in range(12)]
    rare = [f"r{k}" for k in range(400)]

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))

    items = [(k, text(rng.randrange(8, 60)) + ". " + text(rng.randrange(3, 8)).capitalize() + ".") for k in range(60)]
    items.append((60, text(150)))
    docs = [text(rng.randrange(1, 400)) for _ in range(60)]
    for k in range(0, 60, 3):
        words = docs[k].split()
        at = rng.randrange(len(words) + 1)
        docs[k] = " ".join(words[:at] + [items[rng.randrange(61)][1]] + words[at:])
    for k in range(1, 60, 6):  # partly edited items
        words = items[k][1].split()
        for j in range(0, len(words), 7):
            words[j] = "zz"
        docs[k] += " " + " ".join(words)
    return items, docs


def parts_of(t):
    """Runs of PART_WORDS words; where under a quarter of one would be left, the last words."""
    w = tokens(t)
    out = [w[lo : lo + D.PART_WORDS] for lo in range(0, len(w), D.PART_WORDS)]
    if len(out) > 1 and len(out[-1]) < D.PART_WORDS / 4:
        out[-1] = w[-D.PART_WORDS :]
    return out


def frequencies(items):
    """How many parts hold each word, how many parts there are, and their mean length."""
    parts = [p for _, t in items for p in parts_of(t)]
    df = Counter(w for p in parts for w in set(p))
    return {int(D._words(w)[0]): n for w, n in df.items()}, len(parts), sum(map(len, parts)) / len(parts)


def exhaustive(index, passage):
    """Score of every part for a passage by going through all postings."""
    have = set(int(x) for x in passage)
    scores = np.zeros(index.n_parts)
    for k, t in enumerate(index.terms):
        if int(t) in have:
            for p in range(index.bounds[k], index.bounds[k + 1]):
                scores[index.parts[p]] += index.impacts[p]
    return scores


def test_wand_equals_exhaustive_scoring(world):
    items, docs = world
    index = D.Index(items, *frequencies(items))
    checked = 0
    for text in docs:
        h = D._words(text)
        for lo in range(0, max(1, len(h)), 50):
            passage = h[lo : lo + 128]
            scores = exhaustive(index, passage)
            terms = np.unique(index.lookup(passage))
            for threshold in (0.05, 0.2, 0.4, 0.6, 0.9):
                got = dict(index.wand(terms[terms >= 0].tolist(), threshold))
                want = {p for p in range(index.n_parts) if scores[p] >= threshold - 1e-9}
                assert set(got) == want
                assert all(math.isclose(got[p], scores[p], abs_tol=1e-9) for p in want)
                checked += len(want)
    assert checked > 100


def test_impacts_are_bm25_shares(world):
    items, _ = world
    df, n, mean = frequencies(items)
    index = D.Index(items, df, n, mean)
    words = tokens(items[3][1])
    part = index.item.index(3)
    raw = {}
    for w, tf in Counter(words).items():
        d = df[int(D._words(w)[0])]
        raw[w] = math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    for w, x in raw.items():
        k = int(index.lookup(D._words(w))[0])
        at = [p for p in range(index.bounds[k], index.bounds[k + 1]) if index.parts[p] == part]
        assert index.impacts[at[0]] == pytest.approx(x / sum(raw.values()))


def brute_leaks(items, docs, index):
    out = set()
    for r, text in enumerate(docs):
        h = D._words(text)
        found = {}
        n_windows = max(1, -(-len(h) // D.PART_WORDS) - 1)
        for w in range(n_windows):
            passage = h[w * D.PART_WORDS : (w + 2) * D.PART_WORDS]
            if not len(passage):
                continue
            scores = exhaustive(index, passage)
            for p in np.flatnonzero(scores >= D.THRESHOLD - 1e-9):
                found.setdefault(index.item[p], set()).update(D._pairs(passage) | set(passage.tolist()))
        for item, have in found.items():
            q, a = index.question[item], index.answer[item]
            if len(q & have) >= D.QUESTION * len(q) and len(a & have) >= D.ANSWER * len(a):
                out.add((r, item))
    return out


def test_leaks_equal_brute_force(world):
    items, docs = world
    index = D.Index(items, *frequencies(items))
    got = {(r, i) for r, i, *_ in index.leaks(pa.array(docs))}
    assert got == brute_leaks(items, docs, index)
    assert len(got) >= 20


def test_every_planted_item_is_found(spark, world):
    items, docs = world
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()}
    for r, text in enumerate(docs):
        for item, t in items:
            if t in text:
                assert (r, item) in got
    clean = {r["doc_id"] for r in D.keep_clean(frame, bench).collect()}
    assert clean == set(range(len(docs))) - {d for d, _ in got}


def test_shards_give_the_same_leaks(spark, world, monkeypatch):
    items, docs = world
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()}
    original = D.indexes
    monkeypatch.setattr(D, "indexes", lambda b: original(b, shard_bytes=4000))
    assert len(list(D.indexes(bench))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame, bench).collect()} == whole


def test_real_documents(spark, documents, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(documents, benchmark).collect()}
    items = [(r["item_id"], tokens(r["text"])) for r in benchmark.collect()]
    for d in documents.collect():
        text = " " + " ".join(tokens(d["text"])) + " "
        for item, words in items:
            if f" {' '.join(words)} " in text:
                assert (d["doc_id"], item) in got


def test_document_frequencies_are_of_parts(spark, world):
    items = world[0] + [(61, " ".join(["word"] * 70 + ["other"] * 70))]
    table = D._word_table(spark.createDataFrame(items, "item_id long, text string").repartition(3)).collect()
    df, n, mean = frequencies(items)
    assert {r["word"] & (1 << 64) - 1: r["n"] for r in table if r["kind"] == 0} == df
    whole = {r["kind"]: r["n"] for r in table if r["kind"]}
    assert whole[1] == n and whole[2] == pytest.approx(n * mean)


def test_postings_in_chunks_give_the_same_leaks(spark, world, monkeypatch):
    items, docs = world
    index = next(D.indexes(spark.createDataFrame(items, "item_id long, text string")))
    want = index.leaks(pa.array(docs))
    monkeypatch.setattr(D, "POSTINGS", 7)
    assert want and index.leaks(pa.array(docs)) == want


def test_ids_of_any_type(spark, world):
    items, docs = world
    one = D.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string"))
    two = D.find_leaks(
        spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(docs)], "doc_id string, text string"),
        spark.createDataFrame([(f"i{k}", t) for k, t in items], "item_id string, text string"),
    )
    assert {(f"d{r[0]}", f"i{r[1]}") for r in one.collect()} == {(r[0], r[1]) for r in two.collect()}


def test_split_item():
    assert D.split_item("What is it?\nA thing.") == ("What is it?", "A thing.")
    assert D.split_item("One. Two is here. Three") == ("One. Two is here. ", "Three")
    assert D.split_item("only one") == ("only one", "")


def test_odd_rows(spark, odd, empty, benchmark):
    assert D.find_leaks(odd, benchmark).count() == 0
    assert D.keep_clean(odd, benchmark).count() == odd.count()
    assert D.keep_clean(odd, benchmark).columns == odd.columns
    assert D.find_leaks(empty, benchmark).count() == 0
    none = spark.createDataFrame([(1, None), (None, "some item"), (2, ""), (3, "...")], "item_id long, text string")
    assert D.find_leaks(odd, none).count() == 0
    item = spark.createDataFrame([(1, "plain words of a short text"), (2, "plain words of a short text")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(odd, item).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2)]
