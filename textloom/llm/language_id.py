"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's labelled text.  A text
is parsed, left to right, into phrases that are each the longest match in the
automaton (a character that never occurs there ends the phrase it follows).  The phrases
times log2 of the training length over the characters estimates the bits a
character costs in that language; the language with the fewest wins.

To parse thousands of texts in step, a text is cut into blocks of BLOCK
characters, which are first all parsed from the root.  Then each block is parsed
again from the state in which the block before it ends, up to where both parses are
in the same state, until no block's first state changes; so phrases cross blocks.
The automaton is a table (state, character class) -> state in which a mismatch
already leads through the root and marks the end of a phrase.

Training.  Labelled texts are cut into pieces of at most PIECE_CHARS characters, all
of them, and TRAIN_PIECES pieces a language are drawn by a seeded hash from all pieces
of all its texts, so no text is dropped for its length and none counts by its
beginning alone.  The automaton holds the pieces drawn, each ended by a line feed.

Defined results.  A null text, or one without a letter, has no language: null
and null bits.  Equal bits go to the language first in the alphabet.  Rows
without a language label or text don't train; without any training text every
language is null.  Repeated rows get equal results, a row each; repeated labelled
rows train once.  Pieces of equal hashes are drawn in order of doc_id, text and place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import need
from textloom.llm.kit import codepoints, lower, pieces

#: Pieces of labelled text a language trains on at most, and characters of a piece.
TRAIN_PIECES = 40
PIECE_CHARS = 1500
BLOCK = 512
#: Bytes of a language's table up to which it is dense; beyond, only its edges are held.
DENSE_BYTES = 32 << 20


def _letters() -> np.ndarray:
    """1 for code points that are letters or marks."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)], bool)


class SuffixAutomaton:
    """Suffix automaton of a sequence of small integers, built online."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def parsing_table(self, width: int) -> Table:
        """(State, class) -> next state, or its complement where a phrase ends."""
        return Table(self.next, width)


class Table:
    """Steps of an automaton; a mismatch already leads through the root.

    A phrase that ends restarts at the root; there a lone unknown character stays at
    the root.  Small tables are dense; of large alphabets the edges alone are held,
    sorted by state and class.
    """

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width = width
        root = np.zeros(width, np.int32)
        root[list(edges[0])] = list(edges[0].values())
        self.restart = ~root
        self.dense = self.keys = None
        if len(edges) * width * 4 <= DENSE_BYTES:
            step = np.tile(self.restart, (len(edges), 1))
            for s, out in enumerate(edges):
                if out:
                    step[s, list(out)] = list(out.values())
            self.dense = step.reshape(-1)
        else:
            keys = np.array([s * width + c for s, out in enumerate(edges) for c in out], np.int64)
            to = np.array([t for out in edges for t in out.values()], np.int32)
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[state * np.int32(self.width) + code]
        key = state.astype(np.int64) * self.width + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.restart[code])


class Parser:
    """Automata of all languages over one set of character classes.

    Every letter of the training texts has a class of its own; class 0 is every
    letter that they don't hold, class 1 is white space and whatever is no letter.
    An automaton's table is as wide as its own language's alphabet: to it, letters
    of the other languages are class 0.
    """

    def __init__(self, texts: dict[str, str]):
        self.letters = _letters()
        self.languages = sorted(texts)
        chars = {lang: np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32) for lang in self.languages}
        seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *chars.values()]))
        kept = seen[self.letters[seen]]
        self.classes = np.where(self.letters, 0, 1).astype(np.min_scalar_type(len(kept) + 1))
        self.classes[kept] = np.arange(2, 2 + len(kept))
        self.tables, self.bits, self.own = [], [], []
        for lang in self.languages:
            codes = self.encode(chars[lang])
            alphabet = np.unique(codes[codes > 1])
            own = np.zeros(len(kept) + 2, np.int32)
            own[1] = 1
            own[alphabet] = np.arange(2, 2 + len(alphabet))
            self.own.append(own)
            self.tables.append(SuffixAutomaton(own[codes].tolist()).parsing_table(len(alphabet) + 2))
            self.bits.append(math.log2(max(2, len(codes))))

    def encode(self, chars: np.ndarray) -> np.ndarray:
        return self.classes[chars]

    def phrases(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each row (rows by languages); ``at`` holds the rows' bounds."""
        n_rows = len(at) - 1
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        row = np.repeat(np.arange(n_rows), blocks)
        if not len(row):
            return np.zeros((n_rows, len(self.languages)))
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = at[row] + nth * BLOCK
        length = np.minimum(BLOCK, at[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(nth > 0)
        # blocks that follow another of their row, and the ones before them
        after, before = place[later], place[later - 1]
        start, length, row = start[order], length[order], row[order]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # blocks longer than t
        off = np.concatenate(([0], np.cumsum(alive)))  # step t of block j is kept at off[t] + j
        shared = np.concatenate([codes[start[:m] + t] for t, m in enumerate(alive.tolist())])
        out = np.empty((n_rows, len(self.languages)))
        kept = np.empty(len(shared), np.int32)
        for k, (table, own) in enumerate(zip(self.tables, self.own)):
            local = own[shared]
            state = np.zeros(len(row), np.int32)
            count = np.zeros(len(row), np.int32)
            for t, m in enumerate(alive.tolist()):
                v = table.step(state[:m], local[off[t] : off[t] + m])
                sign = v >> 31
                count[:m] -= sign
                state[:m] = v ^ sign
                kept[off[t] : off[t] + m] = v
            first = np.zeros(len(row), np.int32)
            while len(j := after[first[after] != state[before]]):
                first[j] = now = state[before[first[after] != state[before]]]
                for t in range(len(alive)):
                    ended = length[j] == t
                    if ended.any():
                        state[j[ended]] = now[ended]
                        j, now = j[~ended], now[~ended]
                    if not len(j):
                        break
                    spot = off[t] + j
                    v = table.step(now, local[spot])
                    old = kept[spot]
                    kept[spot] = v
                    sign = v >> 31
                    count[j] += (old >> 31) - sign
                    now = v ^ sign
                    differs = now != (old ^ (old >> 31))
                    j, now = j[differs], now[differs]
                state[j] = now
            # a row's last phrase ends with the row
            out[:, k] = np.bincount(row, count, n_rows) + (size > 0)
        return out

    def identify(self, arr: pa.Array) -> tuple[list[str | None], list[float | None], list[float | None]]:
        """Language, its bits a character, and by how many bits it leads the next."""
        n = len(arr)
        langs: list = [None] * n
        bits: list = [None] * n
        lead: list = [None] * n
        if not self.languages:
            return langs, bits, lead
        for lo, hi, part in pieces(lower(arr), 1 << 21):
            chars, at = codepoints(part)
            codes = self.encode(chars)
            letters = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(codes != 1, out=letters[1:])
            has = letters[at[1:]] > letters[at[:-1]]
            rate = self.phrases(codes, at) * np.array(self.bits) / np.maximum(1, np.diff(at))[:, None]
            best = rate.argmin(1)
            top = np.sort(rate, 1)
            for k in np.flatnonzero(has):
                langs[lo + k] = self.languages[best[k]]
                bits[lo + k] = float(top[k, 0])
                lead[lo + k] = float(top[k, 1] - top[k, 0]) if top.shape[1] > 1 else None
        return langs, bits, lead


_parsers: dict[int, Parser] = {}


def _parser(key: int, texts: dict[str, str]) -> Parser:
    """One parser a Python worker, built from the broadcast texts."""
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts)
    return _parsers[key]


def training_texts(docs: DataFrame, pieces_each: int = TRAIN_PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, str]:
    """Labelled text a language: pieces of its documents in the order of a seeded hash.

    Pieces are ranked by narrow columns, and a partition hands on its first ones alone;
    only the pieces drawn are read and collected, so at most ``pieces_each`` times
    ``piece_chars`` characters a language reach the driver.
    """
    labelled = need(docs, "doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece_chars).cast("int"))
    every = labelled.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.explode(places).alias("place"))
    order = [F.xxhash64("doc_id", "place", F.lit(31)), F.col("doc_id"), F.col("h"), F.col("place")]
    drawn = (
        every.distinct()
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("r") <= pieces_each)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "h", "place", "r")
    )
    rows = (
        labelled.withColumn("hash", F.xxhash64("text"))
        .join(F.broadcast(drawn), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label")) & (F.col("hash") == F.col("h")))
        .select("label", "r", F.col("text").substr(F.col("place") * piece_chars + 1, F.lit(piece_chars)).alias("text"))
        .distinct()
        .collect()
    )
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["r"])):
        texts[r["label"]] = texts.get(r["label"], "") + r["text"].lower() + "\n"
    return texts


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, language, bits a character, lead in bits, of every row."""
    texts = training_texts(docs) if texts is None else texts
    key = hash(tuple(sorted(texts.items())))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # TRAIN_PIECES * PIECE_CHARS characters a language at most

    @F.arrow_udf("struct<language string, bits double, lead double>")
    def best(arr: pa.Array) -> pa.Array:
        langs, bits, lead = _parser(key, shared.value).identify(arr)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(bits, pa.float64()), pa.array(lead, pa.float64())], ["language", "bits", "lead"]
        )

    return need(docs, "doc_id", "text").withColumn("best", best("text")).select("doc_id", "best.language", "best.bits", "best.lead")
