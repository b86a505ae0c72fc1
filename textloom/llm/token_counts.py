"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once and whole.  The tokens of a byte-level vocabulary
spell its bytes exactly, so their spans are running sums of the lengths of
vocabulary entries.  These spans are interval-joined to the sections' spans: a
merge of two ordered lists, done for a batch by one binary search.  A token that
crosses a boundary goes to one section by the rule:

"first"     the section with the token's first byte (the default),
"last"      the section with its last byte,
"majority"  the section with most of its bytes, the earlier one on a draw.

A section is a line with its line feed, unless other spans are given; the spans
of a document cover it without gaps, so the counts of its sections add up to its
tokens.

Defined results.  A null or empty text has no section and gives no row.  A blank
line is a section, often of zero tokens where a token spans several line feeds.
Repeated rows give repeated rows.  Texts of any length are encoded whole.  Ids may be
of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import need, tuned, type_of
from textloom.llm.kit import char_starts, flat, pieces
from textloom.llm.tokenizer import DEFAULT_TOKENIZER, tokenizer

RULES = ("first", "last", "majority")


def line_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which a batch's sections begin: rows and lines."""
    after = np.flatnonzero(buf == 10) + 1
    begins = np.unique(np.concatenate([after, off[:-1]]))
    return begins[begins < len(buf)]


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, end: int, rule: str) -> np.ndarray:
    """Section of each token [first, last) among sections that begin at ``begins``."""
    a = np.searchsorted(begins, first, "right") - 1
    if rule == "first":
        return a
    b = np.searchsorted(begins, np.maximum(last - 1, first), "right") - 1
    if rule == "last":
        return b
    bounds = np.append(begins, end)
    best, most = a.copy(), np.minimum(last, bounds[a + 1]) - first
    for k in np.flatnonzero(b > a):
        for s in range(a[k] + 1, b[k] + 1):
            n = min(last[k], bounds[s + 1]) - bounds[s]
            if n > most[k]:
                best[k], most[k] = s, n
    return best


def count_sections(
    docs: DataFrame,
    rule: str = "first",
    path: str = DEFAULT_TOKENIZER,
    sections: Callable[[np.ndarray, np.ndarray], np.ndarray] = line_starts,
) -> DataFrame:
    """doc_id, section (from 0), start_char, end_char, n_tokens: a row a section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(path)
        for batch in batches:
            for lo, hi, some in pieces(batch["text"], 1 << 20):
                buf, off = flat(some)
                if not len(buf):
                    continue
                ids, _ = codec.encode_rows(some)
                ends = np.cumsum(codec.bytes_of[ids], dtype=np.int64)
                begins = sections(buf, off)
                owner = attribute(ends - codec.bytes_of[ids], ends, begins, len(buf), rule)
                n = np.bincount(owner, minlength=len(begins))
                row = np.searchsorted(off, begins, "right") - 1
                chars = char_starts(buf)
                start, end = chars[begins], chars[np.append(begins[1:], len(buf))]
                new = np.concatenate(([True], row[1:] != row[:-1]))
                head = np.flatnonzero(new)
                nth = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
                base = chars[off[row]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(nth.astype(np.int32)),
                        pa.array(start - base),
                        pa.array(end - base),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens"],
                )

    rows = need(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, section int, start_char long, end_char long, n_tokens long")
