"""Language-model scoring: stupid backoff over the whole corpus, relationally.

The score of a word after its context is the relative frequency of the longest
n-gram with a count of ``min_count`` or more, times ALPHA for every word of context
given up; a unigram's frequency is over all words.  A document's score is the sum of
logarithms.  With a ``min_count`` of 1 every counted n-gram scores; the default of 2
lets n-grams seen once back off, as the documents score against counts that hold
themselves, in which an n-gram of one document is no evidence.

Four tables, joined by keys:

1. blocks (block, n_words, data): runs of documents of about BLOCK_BYTES of text,
   packed, and written once, so later steps read the same rows in the same order.
2. n-grams (part, block, first, grams, counts): a block's texts exploded to n-grams
   of 1..order words, hashed and grouped.  A block's distinct n-grams leave it
   partitioned by range of their hash, a row a range that holds any: sorted hashes as
   differences in byte planes, which takes a fifth of a row an n-gram.  So there are
   never more rows than distinct n-grams, however many ranges.
3. counts (block, part, counts): a range's rows summed over all blocks, joined back to
   each block's n-grams of the range, and returned by block.
4. blocks and counts meet by block in a co-grouped join; exploded n-grams take their
   counts in order of their hash, and each document sums its own.

A very frequent n-gram is one entry a block, so no range is skewed by it.  Ranges grow
in number with the words, not in size; ranges are shuffled over at most PARTITIONS
partitions, which take one range after the other.  Hashes keep 56 bits.

Defined results.  A text without a word (null, empty) has 0 words, score 0 and a
null mean.  Words and texts of any length count whole.  Repeated rows count as
often as they stand there, and each gets its score.  An empty table gives no row.
Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import need, saved, tuned, type_of
from textloom.llm.kit import U64, flat, lower, ngrams, text_array, unique_sorted, word_spans, words
from textloom.llm.kit import pieces as pieces_of

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
BLOCK_BYTES = 12 << 20
#: Distinct n-grams of blocks that a range holds, about, and partitions of ranges at most.
RANGE_GRAMS, PARTITIONS = 4 << 20, 20_000
HASH_BITS = 56
_DROP = U64(64 - HASH_BITS)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    codec = pa.Codec("zstd", 1)
    body = [codec.compress(p.tobytes(), asbytes=True) for p in planes]
    head = np.array([len(values), width, *map(len, body)], "<u4").tobytes()
    return head + b"".join(body)


def unpack(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    sizes = np.frombuffer(data, "<u4", width, 8).tolist()
    out = np.zeros((n, 8), np.uint8)
    codec, at = pa.Codec("zstd"), 8 + 4 * width
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(codec.decompress(data[at : at + size], n, asbytes=True), np.uint8) if n else 0
        at += size
    return out.reshape(-1).view("<u8").astype(U64)


def exploded(arr: pa.Array, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order: hashes of n-grams and the positions of their last words; the rows of all words."""
    hs, rows = [], []
    for lo, _, part in pieces_of(arr):
        h, row = words(lower(part))
        hs.append(h)
        rows.append((row + lo).astype(np.int32))
    h = np.concatenate(hs) if hs else np.zeros(0, U64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    del hs, rows
    grams, last = [h >> _DROP], [np.arange(len(h), dtype=np.int32)]
    for n in range(2, order + 1):
        g, at = ngrams(h, row, n)
        grams.append(g >> _DROP)
        last.append((at + (n - 1)).astype(np.int32))
    return grams, last, row


def _runs_of_rows(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.Table]:
    """Runs of a partition's rows of about ``block_bytes`` of text."""
    held, size = [], 0
    for batch in batches:
        text = text_array(batch["text"])
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
        for lo, hi, part in pieces_of(text, 1 << 20):
            held.append(batch.slice(lo, hi - lo))
            size += part.nbytes
            if size >= block_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for nth, rows in enumerate(_runs_of_rows(batches, block_bytes)):
            n = sum(len(word_spans(*flat(part))[0]) for _, _, part in pieces_of(rows["text"]))
            yield pa.RecordBatch.from_pydict({"block": [task << 32 | nth], "n_words": [n], "data": [_packed(rows)]})

    return run


def _parts(grams: np.ndarray, n_parts: int) -> np.ndarray:
    """Range of each hash, by equal shares of the hashes' first 32 bits."""
    return (grams >> U64(HASH_BITS - 32)) * U64(n_parts) >> U64(32)


def _count(order: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"]):
                grams, _, _ = exploded(_unpacked(data.as_py())["text"], order)
                every = np.concatenate(grams)
                del grams
                key, n = unique_sorted(every)
                del every
                if not len(key):
                    continue
                part = _parts(key, n_parts)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(part[lo])], pa.int64()),
                            pa.array([block], pa.int64()),
                            pa.array([int(key[lo])], pa.int64()),
                            pa.array([pack(np.diff(key[lo:hi]))], pa.binary()),
                            pa.array([pack(n[lo:hi])], pa.binary()),
                        ],
                        ["part", "block", "first", "grams", "counts"],
                    )

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range; each range is summed and handed back by block."""

    def totals(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(np.concatenate(([U64(r["first"])], unpack(r["grams"]))), dtype=U64) for r in rows]
        every, _ = unique_sorted(np.concatenate(keys))
        sums = np.zeros(len(every), np.int64)
        places = []
        for key, r in zip(keys, rows):
            at = np.searchsorted(every, key).astype(np.int32)
            sums[at] += unpack(r["counts"]).astype(np.int64)
            places.append(at)
        del keys
        for at, r in zip(places, rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"]], pa.int64()), pa.array([r["part"]], pa.int64()), pa.array([pack(sums[at])], pa.binary())],
                ["block", "part", "counts"],
            )

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield from totals(held)
                held = []
            held.append(r)
    if held:
        yield from totals(held)


def score_rows(last: list[np.ndarray], counts: list[np.ndarray], row: np.ndarray, n_rows: int, n_words: int, min_count: int, alpha: float) -> np.ndarray:
    """Sums of log scores by row; counts of n-grams are aligned with the positions of their last words."""
    m = len(row)
    first = np.searchsorted(row, row)  # each word's row's first word
    place = np.arange(m) - first
    level = np.zeros(m, np.int64)
    log = np.log(counts[0] / max(1, n_words)) if m else np.zeros(0)
    context = counts[0].astype(float)
    for n in range(2, len(counts) + 1):
        at, c = last[n - 1], counts[n - 1]
        held = c >= min_count
        spot = at[held]
        # the context is the run of n - 1 words that ends one word before
        log[spot] = np.log(c[held] / context[spot - 1])
        level[spot] = n - 1
        context = np.zeros(m)
        context[at] = c
    available = np.minimum(place, len(counts) - 1)
    return np.bincount(row, log + (available - level) * np.log(alpha), n_rows) if m else np.zeros(n_rows)


def _score(order: int, n_words: int, min_count: int, alpha: float):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        """One block's documents, and the counts of its n-grams by range."""
        rows = _unpacked(blocks["data"][0].as_py())
        grams, last, row = exploded(rows["text"], order)
        n = rows.num_rows
        total = np.zeros(n)
        if len(row):
            counts = counts.sort_by("part")
            held = np.concatenate([unpack(x.as_py()) for x in counts["counts"]]).astype(np.int64)
            cuts = np.cumsum([len(g) for g in grams])
            every = np.concatenate(grams)
            grams.clear()  # large arrays go as soon as the next one is made
            order_ = np.argsort(every)
            every = every[order_]
            number = np.cumsum(np.concatenate(([False], every[1:] != every[:-1])), dtype=np.int32)
            del every
            if number[-1] + 1 != len(held):
                raise RuntimeError("a block's counts are not of its n-grams")
            each = np.empty(len(order_), np.int64)
            each[order_] = held[number]
            del order_, number, held
            total = score_rows(last, np.split(each, cuts[:-1]), row, n, n_words, min_count, alpha)
            del each
        size = np.bincount(row, minlength=n)
        mean = np.where(size > 0, total / np.maximum(1, size), np.nan)
        return pa.Table.from_arrays(
            [rows["doc_id"], pa.array(size), pa.array(total), pa.array(mean, mask=size == 0)],
            ["doc_id", "n_words", "log_score", "mean_log_score"],
        )

    return run


def score(
    docs: DataFrame,
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
    range_grams: int = RANGE_GRAMS,
) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score (natural logarithms) of every row.

    ``min_count``: n-grams of two words or more that are seen less often back off.
    """
    tuned(docs.sparkSession)
    ids = type_of(docs, "doc_id")
    rows = need(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = saved(rows.mapInArrow(_blocks(block_bytes), "block long, n_words long, data binary"), compression="none")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    n_parts = max(1, -(-n_words * order // range_grams))
    partitions = min(n_parts, PARTITIONS)
    grams = blocks.select("block", "data").mapInArrow(_count(order, n_parts), "part long, block long, first long, grams binary, counts binary")
    counts = (
        grams.repartitionById(partitions, F.floor(F.col("part") * partitions / n_parts).cast("int"))
        .sortWithinPartitions("part")
        .mapInArrow(_total, "block long, part long, counts binary")
    )
    scored = _score(order, n_words, min_count, alpha)
    return (
        blocks.select("block", "data")
        .groupBy("block")
        .cogroup(counts.groupBy("block"))
        .applyInArrow(scored, f"doc_id {ids}, n_words long, log_score double, mean_log_score double")
    )


#: The score by SQL; {least} is min_count.
LM_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w AS w3, lag(w, 1) OVER d AS w2, lag(w, 2) OVER d AS w1 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w3 AS a, count(*) AS n FROM g GROUP BY 1),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
s AS (
  SELECT g.doc_id, CASE
    WHEN c3.n >= {least} THEN ln(c3.n / ctx.n)
    WHEN c2.n >= {least} THEN ln(c2.n / u2.n) + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(u3.n / (SELECT count(*) FROM t)) + CASE WHEN g.w2 IS NULL THEN 0 WHEN g.w1 IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END
  END AS l
  FROM g JOIN c1 u3 ON u3.a = g.w3 LEFT JOIN c1 u2 ON u2.a = g.w2
  LEFT JOIN c2 ON c2.a = g.w2 AND c2.b = g.w3 LEFT JOIN c2 ctx ON ctx.a = g.w1 AND ctx.b = g.w2
  LEFT JOIN c3 ON c3.a = g.w1 AND c3.b = g.w2 AND c3.c = g.w3),
p AS (SELECT doc_id, count(*) AS n_words, sum(l) AS log_score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_words, 0) AS n_words, round(coalesce(p.log_score, 0), 3) AS log_score,
       round(p.log_score / p.n_words, 5) AS mean_log_score
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id
"""
