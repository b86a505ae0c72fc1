"""Vectorised text primitives over Arrow batches.

A batch of strings is one byte buffer with offsets.  Words, n-grams and their
64-bit hashes are found by whole-array NumPy steps over that buffer, so the
Python cost is a few nanoseconds a byte and no Python object is made a word.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes, which
keeps every letter of UTF-8 text; white space and ASCII punctuation separate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: 0: white space and control bytes, 1: word bytes, 2: other marks.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[127] = 0
KIND[128:] = 1
for _span in (b"09", b"AZ", b"az"):
    KIND[_span[0] : _span[1] + 1] = 1

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all their bits are usable."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def text_array(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null text is an empty text)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "")


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array that has no nulls."""
    arr = text_array(arr)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    n = len(arr)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(arr: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    arr = text_array(arr)
    _, off = flat(arr)
    lo, n = 0, len(arr)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, arr.slice(lo, hi - lo)
        lo = hi


def lower(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(text_array(arr))


def _runs(mark: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal non-zero marks that stay in a row."""
    n = len(mark)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(n + 1, bool)
    np.not_equal(mark[1:], mark[:-1], out=cut[1:n])
    cut[0] = cut[n] = True
    cut[off] = True
    edge = np.flatnonzero(cut)
    begin, end = edge[:-1], edge[1:]
    keep = mark[begin] > 0
    return begin[keep], end[keep]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    s, e = _runs((KIND[buf] == 1).view(np.uint8), off)
    return s, e, np.searchsorted(off, s, "right") - 1


def token_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of word bytes or of marks."""
    s, e = _runs(KIND[buf], off)
    return s, e, np.searchsorted(off, s, "right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """Rolling sums by which any span hashes in constant time."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes hash equally anywhere."""
    _, down = powers(len(sums) + 1)
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of already lower-cased texts, in order."""
    buf, off = flat(arr)
    s, e, row = word_spans(buf, off)
    return span_hashes(prefix(buf), s, e), row


_ODD = [U64(pow(0xC2B2AE3D27D4EB4F, 2 * k + 1, 1 << 64)) for k in range(64)]


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n items within a row, and the position of each run's first item."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(m, U64(n), U64)
    for k in range(n):
        total += h[k : k + m] * _ODD[k]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(total[at] if len(at) < m else total), at


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """For sorted row numbers: where each row's items begin, with the end."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def sum_by_row(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(row, values, n_rows)


def unique_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    v = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return v[at], np.diff(np.append(at, len(v)))


def codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and each row's first position among them."""
    buf, off = flat(arr)
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return chars, lead[off]


def char_starts(buf: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte position."""
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead
