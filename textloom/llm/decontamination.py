"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

Index.  Items are the documents of the index, cut into parts of at most
PART_WORDS words.  A posting's impact is the word's BM25 share of the part's
score against itself, so a passage that holds all of a part's words scores 1,
and one threshold fits short and long items.  A word's postings are in part
order, in blocks of BLOCK with the greatest impact of each block.

Search.  Every training passage is a query: windows of 2 * PART_WORDS words
every PART_WORDS words, so every run of PART_WORDS words is whole in one of
them.  A batched bound first drops passages that cannot reach the threshold: the
most frequent words are non-essential as long as they give no part more than
half the threshold together; a part can only reach the threshold if its
essential words in the passage make up for the rest.  Passages for which that
holds for some part go through block-max WAND, which returns every part at or
above the threshold.  Nothing is capped, and the result equals exhaustive BM25.

Verification.  An item's text up to its last line (or last sentence) is its
question, the rest its answer.  A document leaks an item if the passages found
for it hold at least QUESTION of the question's word pairs and ANSWER of the
answer's.

Document frequencies and the mean length are of parts, over the whole benchmark.  The
index is broadcast in shards of about SHARD_BYTES of item text, one pass over the
documents a shard, so no broadcast grows with the benchmark; a shard looks up the
frequencies of its own words alone.  Postings are expanded POSTINGS at a time.

Defined results.  Null or empty texts have no passage; null or empty items are
not indexed.  Texts are read whole in lower case.  Repeated rows give repeated
results; equal items are found each.  Other columns are not read.  Ids may be of any
type.  A part at the threshold is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import need, saved, tuned, type_of
from textloom.llm.kit import lower, ngrams, pieces, words

PART_WORDS = 64
BLOCK = 16
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.5
SHARD_BYTES = 8 << 20
POSTINGS = 1 << 21
K1, B = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line, else the last sentence, answers."""
    text = text.strip()
    if "\n" in text:
        q, _, a = text.rpartition("\n")
        return q, a
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def _words(text: str) -> np.ndarray:
    return words(lower(pa.array([text], pa.string())))[0]


def _pairs(h: np.ndarray) -> set[int]:
    """Word pairs, or the one word there is."""
    if len(h) == 1:
        return {int(h[0])}
    return set(ngrams(h, np.zeros(len(h), np.int64), 2)[0].tolist())


def part_bounds(n: int) -> list[tuple[int, int]]:
    """Parts of an item of n words; a short rest is the item's last PART_WORDS words."""
    bounds = [(lo, min(n, lo + PART_WORDS)) for lo in range(0, n, PART_WORDS)]
    if len(bounds) > 1 and n - bounds[-1][0] < PART_WORDS // 4:
        bounds[-1] = (n - PART_WORDS, n)
    return bounds


class Index:
    """Inverted index of one shard of items."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[int, int], all_parts: int, mean_words: float):
        self.item: list = []
        self.question: dict[object, set[int]] = {}
        self.answer: dict[object, set[int]] = {}
        postings: dict[int, list[tuple[int, float]]] = {}
        for item, text in items:
            h = _words(text)
            if not len(h):
                continue
            q, a = (_words(x) for x in split_item(text))
            self.question[item], self.answer[item] = _pairs(q) if len(q) else set(), _pairs(a) if len(a) else set()
            for lo, hi in part_bounds(len(h)):
                part = h[lo:hi]
                t, tf = np.unique(part, return_counts=True)
                df = np.array([frequency.get(int(x), 1) for x in t])
                idf = np.log(1 + (all_parts - df + 0.5) / (df + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean_words))
                impact /= impact.sum()
                p = len(self.item)
                self.item.append(item)
                for x, w in zip(t.tolist(), impact.tolist()):
                    postings.setdefault(x, []).append((p, w))
        self.n_parts = len(self.item)
        order = sorted(postings, key=lambda x: (-len(postings[x]), x))
        self.terms = np.array(sorted(postings), np.uint64)
        place = {int(t): k for k, t in enumerate(self.terms)}
        common = np.zeros(self.n_parts)
        essential = np.ones(len(self.terms), bool)
        for t in order:
            more = common.copy()
            for p, w in postings[t]:
                more[p] += w
            if more.max() > THRESHOLD / 2:
                break
            common, essential[place[t]] = more, False
        self.common, self.essential = common, essential
        lists = [postings[int(t)] for t in self.terms]
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.parts = np.array([p for x in lists for p, _ in x], np.int64)
        self.impacts = np.array([w for x in lists for _, w in x], float)
        self.list_max = np.array([max(w for _, w in x) for x in lists])
        self.blocks = [
            (np.array([x[min(k + BLOCK, len(x)) - 1][0] for k in range(0, len(x), BLOCK)]), np.array([max(w for _, w in x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)]))
            for x in lists
        ]
        # 16 bits of the hash find most absent words without a search
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the index, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[k] == h[maybe]
        out[maybe[hit]] = k[hit]
        return out

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every part whose summed impact over distinct terms reaches the threshold."""
        need_ = threshold - 1e-9
        cursors = [[int(self.bounds[t]), int(self.bounds[t + 1]), t] for t in terms]
        found = []
        parts, impacts = self.parts, self.impacts
        while cursors:
            cursors.sort(key=lambda c: parts[c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.list_max[c[2]]
                if bound >= need_:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = parts[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and parts[cursors[pivot + 1][0]] == doc:
                pivot += 1
            # block bounds at the pivot's part, and the first part beyond these blocks
            shallow, beyond = 0.0, self.n_parts
            for c in cursors[: pivot + 1]:
                last, most = self.blocks[c[2]]
                b = int(np.searchsorted(last, doc))
                if b < len(last):
                    shallow += most[b]
                    beyond = min(beyond, int(last[b]) + 1)
            if pivot + 1 < len(cursors):
                beyond = min(beyond, int(parts[cursors[pivot + 1][0]]))
            if shallow >= need_:
                if parts[cursors[0][0]] == doc:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += impacts[c[0]]
                        c[0] += 1
                    if score >= need_:
                        found.append((int(doc), float(score)))
                else:
                    for c in cursors[:pivot]:
                        if parts[c[0]] < doc:
                            c[0] += int(np.searchsorted(parts[c[0] : c[1]], doc))
            else:
                goal = max(beyond, int(doc) + 1) if beyond <= doc else beyond
                for c in cursors[: pivot + 1]:
                    if parts[c[0]] < goal:
                        c[0] += int(np.searchsorted(parts[c[0] : c[1]], goal))
            cursors = [c for c in cursors if c[0] < c[1]]
        return found

    def candidates(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and first word (within the row) of passages that may reach the threshold."""
        term = self.lookup(h)
        first = np.searchsorted(row, np.arange(n_rows + 1))
        at = np.flatnonzero((term >= 0) & self.essential[term])
        t, r = term[at], row[at]
        local = at - first[r]
        window = local // PART_WORDS
        size = np.diff(first)
        # each word is in the window that begins in its stretch and in the one before
        keys, ts = [], []
        width = np.int64(1) << 32
        last = np.maximum(0, -(-size[r] // PART_WORDS) - 2)  # the last windows reach the end together
        for back in (0, 1):
            w = window - back
            ok = (w >= 0) & (w <= last)
            keys.append(r[ok] * width + w[ok])
            ts.append(t[ok])
        key, tt = np.concatenate(keys), np.concatenate(ts)
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a passage whose essential words can't reach half the threshold at their maxima is out
        order = np.argsort(key, kind="stable")
        key, tt = key[order], tt[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        top = np.add.reduceat(self.list_max[tt], head)  # repeated words only raise the bound
        good = np.repeat(top >= THRESHOLD - self.common.max() - 1e-9, np.diff(np.append(head, len(key))))
        key, tt = key[good], tt[good]
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        head = np.concatenate(([True], key[1:] != key[:-1]))
        number = np.cumsum(head) - 1
        passages = key[head]
        pair = np.unique(number * np.int64(len(self.terms)) + tt)
        number, tt = pair // len(self.terms), pair % len(self.terms)
        n = self.bounds[tt + 1] - self.bounds[tt]
        # whole passages at a time, of about POSTINGS postings
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        chunk = (np.cumsum(n) - n)[first] // POSTINGS
        cuts = [*first[np.concatenate(([True], chunk[1:] != chunk[:-1]))].tolist(), len(number)]
        hits = [self._reaching(number[a:b], tt[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
        hit = np.concatenate(hits)
        return passages[hit] // width, passages[hit] % width * PART_WORDS

    def _reaching(self, number: np.ndarray, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Passages of which some part can reach the threshold by these essential terms."""
        post = np.repeat(self.bounds[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(number, n) * np.int64(self.n_parts) + self.parts[post]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        got = np.add.reduceat(self.impacts[post][order], head)
        reach = got + self.common[cell[head] % self.n_parts] >= THRESHOLD - 1e-9
        return np.unique(cell[head][reach] // self.n_parts)

    def leaks(self, arr: pa.Array) -> list[tuple[int, object, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every verified leak."""
        out = []
        if not self.n_parts:
            return out
        for lo, hi, part in pieces(arr):
            h, row = words(lower(part))
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            held: dict[tuple[int, object], tuple[float, set[int]]] = {}
            for r, w in zip(*self.candidates(h, row, hi - lo)):
                passage = h[first[r] + w : min(first[r] + w + 2 * PART_WORDS, first[r + 1])]
                terms = np.unique(self.lookup(passage))
                pairs = None
                for p, score in self.wand(terms[terms >= 0].tolist(), THRESHOLD):
                    pairs = (_pairs(passage) | set(passage.tolist())) if pairs is None else pairs
                    key = (int(r), self.item[p])
                    best, have = held.get(key, (0.0, set()))
                    held[key] = (max(best, score), have | pairs)
            for (r, item), (score, have) in sorted(held.items()):
                q, a = self.question[item], self.answer[item]
                q_over = len(q & have) / len(q) if q else 1.0
                a_over = len(a & have) / len(a) if a else 1.0
                if q_over >= QUESTION and a_over >= ANSWER:
                    out.append((lo + r, item, score, q_over, a_over))
        return out


def _word_table(items: DataFrame) -> DataFrame:
    """word, n: how many parts hold each word; and rows of kind 1 and 2 with parts and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in pieces(batch["text"]):
                h, row = words(lower(part))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                parts = [np.unique(h[at[k] + x : at[k] + y]) for k in range(hi - lo) for x, y in part_bounds(int(at[k + 1] - at[k]))]
                size = sum(y - x for k in range(hi - lo) for x, y in part_bounds(int(at[k + 1] - at[k])))
                word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(word.view(np.int64), [0, 0])), pa.array(np.append(n, [len(parts), size]).astype(np.int64)), pa.array([0] * len(word) + [1, 2], pa.int32())],
                    ["word", "n", "kind"],
                )

    return items.mapInArrow(count, "word long, n long, kind int").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _own_words(items: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(lower(batch["text"]))[0]).view(np.int64))], ["word"])

    return items.mapInArrow(each, "word long").distinct()


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The benchmark's index, one shard after the other."""
    items = (
        need(benchmark, "item_id", "text")
        .where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select("item_id", F.col("text").cast("string").alias("text"))
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return
    table = saved(_word_table(items))
    whole = {r["kind"]: r["n"] for r in table.where("kind > 0").collect()}
    frequency = table.where("kind = 0").select("word", "n")
    shards = -(-size // shard_bytes)
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        seen = frequency.join(_own_words(mine), "word", "left_semi") if shards > 1 else frequency
        known = {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in seen.collect()}  # words of one shard
        rows = mine.orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], known, whole[1], whole[2] / max(1, whole[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak."""
    spark = tuned(docs.sparkSession)
    rows = need(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, item_id {type_of(benchmark, 'item_id')}, score double, question_overlap double, answer_overlap double"
    kind = to_arrow_type(benchmark.select("item_id").schema[0].dataType)
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.leaks(batch["text"])
                if found:
                    row, item, score, q, a = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(row)), pa.array(item, kind), pa.array(score), pa.array(q), pa.array(a)],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with the same columns."""
    tuned(docs.sparkSession)
    out = docs
    for index in indexes(benchmark):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return out


def _clean(shared):
    """Arrow function: does a text leak no item of this index?"""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        ok = np.ones(len(texts), bool)
        ok[[r for r, *_ in shared.value.leaks(texts)]] = False
        return pa.array(ok)

    return clean
