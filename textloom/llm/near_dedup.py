"""MinHash near-duplicates with odd sketches.

Each text becomes the set of hashes of its runs of SHINGLE words.  K MinHash
samples of it serve twice: bands of ROWS samples find candidates, and folding
all (sample number, minimum) pairs into a parity bitmap of BITS bits, an odd
sketch, verifies them: the population count p of two sketches' XOR estimates the
number of differing samples, hence similarity 1 + BITS/(4K) ln(1 - 2p/BITS).

Equal sample vectors are one node from the start, by a partial aggregation, so
thousands of exact copies make no pair.  Then no band's bucket is ever gathered:

1. Each bucket has a leader, its smallest node, by a partial aggregation.  Every
   node of the bucket is verified against the leader, in rows of their own: that is
   linear, whatever the buckets' sizes, and adaptive joins split hot leaders.  The
   components of these links are the first classes.
2. Buckets whose nodes are in several classes have their nodes of different classes
   verified as well.  A bucket of at most HOT nodes is one task's row group; a larger
   one is cut into blocks of about HOT nodes, classes together, and pairs of blocks
   are row groups of their own, save pairs within one class.  Classes that a verified
   link joins become one, and nothing is capped.

The groups are the connected components of the verified links.

Defined results.  Texts without a word (also null and empty ones) are compared
with nothing: each stays.  Texts of fewer words than SHINGLE have their whole
word sequence as one shingle.  The document with the smallest id stays in a
group.  Rows that share an id, or have none, are rows of their own.  Texts are
read whole, in lower case.  Where ids repeat, miss or aren't integers, the first row
of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, need, saved, tuned, type_of
from textloom.llm.kit import U64, lower, mix, ngrams, pieces, row_bounds, words

SHINGLE = 3
BANDS, ROWS = 40, 4
K = BANDS * ROWS
BITS = 512
THRESHOLD = 0.5
#: Nodes of a bucket that one row group holds, about.
HOT = 2048
#: Ids of dropped rows are broadcast up to this size.
BROADCAST_BYTES = 32 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)


def shingles(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, and the rows' bounds among them."""
    h, row = words(lower(arr))
    n = len(arr)
    g, at = ngrams(h, row, SHINGLE)
    grow = row[at]
    size = np.bincount(row, minlength=n)
    for m in range(1, SHINGLE):  # short texts: all their words
        few = np.flatnonzero(size == m)
        if len(few):
            sg, sat = ngrams(h, row, m)
            srow = row[sat]
            pick = size[srow] == m
            g, grow = np.concatenate([g, sg[pick]]), np.concatenate([grow, srow[pick]])
    order = np.argsort(grow, kind="stable") if len(grow) and (np.diff(grow) < 0).any() else slice(None)
    return g[order], row_bounds(grow[order], n)


def signatures(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """K minima of every row that has a word, and which rows those are."""
    g, at = shingles(arr)
    has = np.flatnonzero(np.diff(at) > 0)
    out = np.empty((len(has), K), np.uint32)
    if len(has):
        x = (g >> U64(32)).astype(np.uint32)
        begin = at[has]
        for k in range(K):
            y = x * _A[k] + _B[k]
            y ^= y >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(y, begin)
    return out, has


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows by BITS/64 words) of (sample number, minimum)."""
    place = mix(minima.astype(U64) + (np.arange(minima.shape[1], dtype=U64) << U64(32))) % U64(BITS)
    out = np.zeros((len(minima), BITS // 64), U64)
    rows = np.arange(len(minima))
    for k in range(minima.shape[1]):
        p = place[:, k]
        out[rows, (p >> U64(6)).astype(np.int64)] ^= U64(1) << (p & U64(63))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches."""
    odd = np.bitwise_count(a ^ b).sum(-1).astype(float)
    return np.maximum(0.0, 1 + BITS / (4 * K) * np.log(np.maximum(1e-9, 1 - 2 * odd / BITS)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, part in pieces(batch["text"]):
            minima, has = signatures(part)
            if not len(has):
                continue
            grouped = minima.reshape(-1, BANDS, ROWS).astype(U64)
            keys = np.zeros(grouped.shape[:2], U64) + np.arange(BANDS, dtype=U64)
            for r in range(ROWS):
                keys = mix(keys * U64(0x9E3779B97F4A7C15) + grouped[:, :, r])
            same = np.zeros((2, len(has)), U64)
            for k in range(K):
                same[0] = mix(same[0] * U64(31) + minima[:, k])
                same[1] = mix(same[1] * U64(37) + minima[:, k] + U64(k))
            bands = pa.ListArray.from_arrays(
                np.arange(0, len(has) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))
            )
            sketch = odd_sketches(minima)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["node"].slice(lo, hi - lo).take(pa.array(has)),
                    pa.array(same[0].view(np.int64)),
                    pa.array(same[1].view(np.int64)),
                    bands,
                    pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, sketch.shape[1], dtype=np.int32), pa.array(sketch.reshape(-1).view(np.int64))),
                ],
                ["node", "s0", "s1", "bands", "sketch"],
            )


def most_odd(threshold: float) -> int:
    """The most differing bits with which two sketches are similar; -1 if none are."""
    odd = np.arange(BITS + 1)
    likely = np.maximum(0.0, 1 + BITS / (4 * K) * np.log(np.maximum(1e-9, 1 - 2 * odd / BITS)))
    return int(np.flatnonzero(likely >= threshold).max(initial=-1))


def differing(a: Column, b: Column) -> Column:
    """Population count of two sketches' XOR."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def class_links(node: np.ndarray, group: np.ndarray, high: np.ndarray, sketch: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """Links (node, node, class, class) that join all similar classes of one row group.

    Where some nodes are of the pair's higher block, only pairs across blocks count:
    the others are those of another row group.  Classes that a link joined are one.
    """
    now = group.copy()
    across = bool(high.any() and not high.all())
    out = []
    for i in range(len(node) - 1):
        other = np.flatnonzero(now[i + 1 :] != now[i]) + i + 1
        if across:
            other = other[high[other] != high[i]]
        hit = other[np.bitwise_count(sketch[i] ^ sketch[other]).sum(1) <= most]
        for j in hit.tolist():
            if now[j] != now[i]:
                out.append((int(node[i]), int(node[j]), int(group[i]), int(group[j])))
                now[now == now[j]] = now[i]
    return out


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            sketch = t["sketch"].combine_chunks().flatten().to_numpy().view(U64).reshape(t.num_rows, -1)
            found = class_links(t["node"].to_numpy(), t["root"].to_numpy(), t["block"].to_numpy() == t["high"].to_numpy(), sketch, most)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["a", "b", "class_a", "class_b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("band", "low", "high")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and any(held[0][c][0] != batch[c][lo] for c in ("band", "low", "high")):
                    yield from links(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from links(held)

    return run


def block_pairs(members: DataFrame, hot: int) -> DataFrame:
    """The rows of ``members`` (band, n, node, root) once for each pair of blocks they
    are tested in, with block and the pair, low and high.

    A bucket of up to ``hot`` nodes is block 0 alone.  In a larger one, a class of more
    than ``hot`` nodes has blocks of its own, by hash of the node, and smaller classes
    share blocks, by hash of the class; a pair of blocks of one class is left out.
    """
    columns = [F.col(c) for c in members.columns]
    small = members.where(F.col("n") <= hot).select(*columns, *[F.lit(0).alias(c) for c in ("block", "low", "high")])
    large = members.where(F.col("n") > hot)
    sizes = large.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    shared = sizes.groupBy("band").agg(
        F.ceil(F.sum(F.when(F.col("m") <= hot, F.col("m")).otherwise(0)) / hot).cast("int").alias("shared"),
        # of large classes there are n / hot at most
        F.array_sort(F.collect_list(F.when(F.col("m") > hot, F.struct("root", F.ceil(F.col("m") / hot).cast("int").alias("own"))))).alias("large"),
    )
    placed = (
        large.join(shared, "band")
        .withColumn("mine", F.get(F.filter("large", lambda x: x["root"] == F.col("root")), F.lit(0))["own"])
        .withColumn("before", F.aggregate(F.filter("large", lambda x: x["root"] < F.col("root")), F.col("shared"), lambda n, x: n + x["own"]))
        .withColumn("total", F.aggregate("large", F.col("shared"), lambda n, x: n + x["own"]))
    )
    block = F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("root"), F.greatest(F.col("shared"), F.lit(1)))).otherwise(F.col("before") + F.pmod(F.xxhash64("node"), F.col("mine"))).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    own = F.col("mine").isNotNull() & (F.col("other") >= F.col("before")) & (F.col("other") < F.col("before") + F.col("mine"))
    return small.unionByName(placed.where(~own).select(*columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component.

    Each round every node takes the smallest label among itself and its
    neighbours, then the label of its label; it ends when nothing changes.
    Rounds are written to the shared folder, so lost executors cost no restart.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = saved(both.distinct())
    labels = saved(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        low = labels.join(near, "x").select("x", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = low.select(F.col("x").alias("root"), F.col("root").alias("up"))
        moved = low.join(jump, "root", "left").select("x", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        moved = saved(moved)
        labels = moved.select("x", "root")
        if not moved.where(F.col("old") != F.col("root")).limit(1).count():
            return labels.select(F.col("x").alias("node"), "root")


def with_node(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """The rows with a column that tells them apart, its name, and is it doc_id?

    Where ids repeat, miss or aren't integers, rows are numbered and written to the
    shared folder, so that the numbers stay the same in every later reading.
    """
    name = fresh(docs, "node")
    if type_of(docs, "doc_id") in ("tinyint", "smallint", "int", "bigint"):
        n = docs.select(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
        if n["rows"] == n["ids"]:
            return docs.withColumn(name, F.col("doc_id").cast("long")), name, True
    return saved(docs.withColumn(name, F.monotonically_increasing_id())), name, False


def group_labels(docs: DataFrame, node: str, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """node, root of every row that is in a group of two or more, and the links a, b found."""
    tuned(docs.sparkSession)
    most = most_odd(threshold)
    texts = docs.select(F.col(f"`{node}`").alias("node"), "text")
    sketches = saved(texts.mapInArrow(_sketch, "node long, s0 long, s1 long, bands array<long>, sketch array<long>"))
    same = saved(sketches.groupBy("s0", "s1").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")))
    firsts = saved(sketches.select("node", "bands", "sketch").join(same.select(F.col("rep").alias("node")), "node", "left_semi"))
    banded = firsts.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(banded.join(leaders, "band").select("band", "n", "lead", "node"))
    pairs = members.where("node <> lead").select("lead", "node").distinct()
    one, two = firsts.select("node", "sketch"), firsts.select(F.col("node").alias("lead"), F.col("sketch").alias("lead_sketch"))
    tested = pairs.join(one, "node").join(two, "lead")
    stars = saved(tested.where(differing(F.col("sketch"), F.col("lead_sketch")) <= most).select(F.col("lead").alias("a"), F.col("node").alias("b")))
    roots = components(stars)
    # a bucket of two has no pair left to test
    placed = members.where("n > 2").join(roots, "node", "left").select("band", "n", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    rest = saved(placed.join(mixed, "band", "left_semi"))
    units = block_pairs(rest, hot).join(one, "node").select("band", "low", "high", "block", "node", "root", "sketch")
    more = saved(
        units.repartition("band", "low", "high")
        .sortWithinPartitions("band", "low", "high", "root", "node")
        .mapInArrow(_verify(most), "a long, b long, class_a long, class_b long")
    )
    merged = components(more.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct())
    roots = roots.unionByName(merged.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    roots = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    copies = sketches.join(same.where("copies > 1").select("s0", "s1", "rep"), ["s0", "s1"]).select("node", "rep")
    every = copies.unionByName(roots.select("node", F.col("node").alias("rep"))).distinct()
    labels = saved(every.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("node", F.coalesce("root", "rep").alias("root")).distinct())
    links = stars.unionByName(more.select("a", "b")).unionByName(copies.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    return labels, links.distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and links of every row.

    class_id is the doc_id of the group's row that stays; a document without
    near-duplicates is a class alone.  links counts the verified links that tie the
    row to others of its class: at least one where there are others.  Copies are
    linked to the first of them, and similar texts by the links that were tested.
    """
    rows, node, is_id = with_node(need(docs, "doc_id", "text"))
    labels, links = group_labels(rows, node, threshold)
    ids = rows.select("doc_id", F.col(node).alias("node"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    every = ids.join(labels, "node", "left").join(degree, "node", "left")
    every = every.select("doc_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    if is_id:
        return every.select("doc_id", F.col("root").cast(type_of(docs, "doc_id")).alias("class_id"), "links")
    names = ids.select(F.col("doc_id").alias("class_id"), F.col("node").alias("root"))
    return every.join(names, "root").select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of a row that stays."""
    rows, node, _ = with_node(docs)
    labels, _ = group_labels(rows, node, threshold)
    gone = labels.where(F.col("node") != F.col("root")).select(F.col("node").alias(node))
    # beyond that size texts are shuffled to meet the ids, in a hash join that sorts none
    gone = F.broadcast(gone) if 8 * gone.count() <= BROADCAST_BYTES else gone.hint("shuffle_hash")
    return rows.join(gone, node, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
