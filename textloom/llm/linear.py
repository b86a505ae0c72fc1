"""Sparse logistic regression by follow-the-regularised-leader updates.

Features are hashed n-grams: an occurrence adds one to its bucket, and a
document's counts are divided by the square root of their number, so the score
is a sparse dot product with no vocabulary to keep.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import need
from textloom.llm.kit import U64, codepoints, flat, lower, mix, ngrams, pieces, prefix, span_hashes, sum_by_row, token_spans


@dataclasses.dataclass(frozen=True)
class Features:
    """What is hashed: n-grams of tokens (and of characters), into 2**bits buckets.

    Tokens are runs of word bytes or of marks, in their own letter case.  Every
    n-gram has the bucket of its own hash.  Beside them, for each of ``repeats``, a
    token that equals the one so many tokens before adds one to a bucket of that
    distance, which shows loops of repeated words.
    """

    bits: int = 18
    word_orders: tuple[int, ...] = (1, 2)
    char_orders: tuple[int, ...] = ()
    repeats: tuple[int, ...] = (1, 2, 3)

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: buckets of all occurrences and their rows."""
        shift = U64(64 - self.bits)
        if self.word_orders:
            buf, off = flat(texts)
            s, e, row = token_spans(buf, off)
            h = span_hashes(prefix(buf), s, e)
            for n in self.word_orders:
                g, at = ngrams(h, row, n)
                yield (g >> shift).astype(np.int32), row[at]
            for lag in self.repeats:
                if len(h) > lag:
                    at = np.flatnonzero((h[:-lag] == h[lag:]) & (row[:-lag] == row[lag:]))
                    g = np.full(len(at), mix(np.array([1000 + lag], U64))[0], U64)
                    yield (g >> shift).astype(np.int32), row[at]
        if self.char_orders:
            chars, at = codepoints(texts)
            row = np.repeat(np.arange(len(texts)), np.diff(at))
            c = chars.astype(U64) + U64(7)
            for n in self.char_orders:
                m = len(c) - n + 1
                if m <= 0:
                    continue
                total = np.full(m, U64(0x51ED270B * n), U64)
                for k in range(n):
                    total = total * U64(0x9E3779B97F4A7C15) + c[k : k + m]
                total ^= total >> U64(31)
                total *= U64(0xD6E8FEB86659FD93)
                ok = row[:m] == row[n - 1 :]
                yield (total[ok] >> shift).astype(np.int32), row[:m][ok]


@dataclasses.dataclass
class Model:
    """Weights with a bias and a calibration: p = sigmoid(a * score + b)."""

    weights: np.ndarray
    bias: float
    features: Features
    a: float = 1.0
    b: float = 0.0

    def scores(self, arr: pa.Array) -> np.ndarray:
        """Log-odds before calibration, one a row; without features, the bias."""
        out = np.empty(len(arr))
        for lo, hi, part in pieces(arr):
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for bucket, row in self.features.of(part):
                total += sum_by_row(self.weights[bucket], row, hi - lo)
                count += np.bincount(row, minlength=hi - lo)
            out[lo:hi] = total / np.sqrt(np.maximum(count, 1)) + self.bias
        return out

    def probabilities(self, arr: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.scores(arr) + self.b, -40, 40)))


def rows_of(features: Features, arr: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and values of each row, for training."""
    out = []
    for k in range(len(arr)):
        parts = [b for b, _ in features.of(arr.slice(k, 1))]
        every = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        every.sort()
        at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        out.append((every[at], np.diff(np.append(at, len(every))) / math.sqrt(max(1, len(every)))))
    return out


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    features: Features,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.5,
    epochs: int = 5,
) -> Model:
    """FTRL-proximal: per-coordinate learning rates, and L1 that leaves zeros.

    Without rows of both classes there is nothing to tell apart: all weights are
    zero, and the bias favours the class seen (neither, if there is none).
    """
    size = 1 << features.bits
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 0.0 if not len(labels) else (4.0 if labels[0] else -4.0), features)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels):
            i = np.append(i, size)
            x = np.append(x, 1.0)
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(w @ x)))))
            g = (p - y) * x
            more = np.sqrt(ni + g * g)
            z[i] = zi + g - (more - root) / alpha * w
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w[:size].astype(np.float32), float(w[size]), features)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid on held-out scores, with his smoothed targets, by Newton steps."""
    up = float(labels.sum())
    down = len(labels) - up
    if not up or not down:
        return 1.0, 0.0
    t = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -40, 40)))
        g = np.array([((p - t) * scores).sum(), (p - t).sum()]) + np.array([1e-3 * (a - 1), 0])
        v = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(v * scores * scores).sum() + 1e-3, (v * scores).sum()], [(v * scores).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = float(np.abs(step).max())
        step *= min(1.0, 2.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows (text, y), chosen by a seeded hash of doc_id.

    A document labelled more than once counts by its majority, and not at all on
    a draw; null ids, labels or texts don't train.  The choice is a top-k of the
    label table alone; only the ids chosen meet the texts.  Of rows that share an id the
    one whose text has the least hash trains, so repeated ids don't swell the sample.
    """
    chosen = (
        need(labels, "doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
        .where(F.col("y") != 0.5)
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(limit)
        .select(F.col("doc_id").alias("id"), (F.col("y") > 0.5).cast("int").alias("y"))
    )
    # `limit` rows of two small columns: broadcast size is bounded by the parameter
    return (
        need(docs, "doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
        .groupBy("doc_id", "y")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("doc_id", "text", "y")
    )


def train(sample: DataFrame, features: Features, calibrated: bool, **options) -> Model:
    """Train in one task on a bounded sample; only the weights reach the driver.

    Rows are ordered by a hash of their id and text, so the model depends on the
    sample alone.  With ``calibrated``, every fifth row is held out for Platt's
    sigmoid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows_in = pa.Table.from_batches(got)
        data = rows_of(features, rows_in["text"].combine_chunks())
        y = rows_in["y"].to_numpy().astype(float)
        held = np.arange(len(y)) % 5 == 4 if calibrated else np.zeros(len(y), bool)
        model = fit([r for r, h in zip(data, held) if not h], y[~held], features, **options)
        a, b = 1.0, 0.0
        if calibrated:
            s = np.array([float(model.weights[i] @ x) + model.bias for (i, x), h in zip(data, held) if h])
            a, b = calibrate(s, y[held]) if len(s) else (a, b)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict(
            {"at": [at.astype(np.int32).tobytes()], "w": [model.weights[at].astype(np.float32).tobytes()], "bias": [model.bias], "a": [a], "b": [b]}
        )

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(23)), "doc_id", F.xxhash64("text"))
    got = ordered.mapInArrow(run, "at binary, w binary, bias double, a double, b double").collect()
    weights = np.zeros(1 << features.bits, np.float32)
    if not got:
        return Model(weights, 0.0, features)
    weights[np.frombuffer(got[0]["at"], np.int32)] = np.frombuffer(got[0]["w"], np.float32)
    return Model(weights, got[0]["bias"], features, got[0]["a"], got[0]["b"])


def scorer(model_of: Callable[[], Model]):
    """Arrow function from texts to calibrated probabilities."""

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(model_of().probabilities(texts))

    return probability


__all__ = ["Features", "Model", "calibrate", "fit", "labelled_sample", "lower", "rows_of", "scorer", "train"]
