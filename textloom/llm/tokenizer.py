"""Byte-level BPE by a public vocabulary, with a memory of words.

Cutting before every space that stands before a non-space never changes the
result: no piece of the tokenizer's pattern spans such a place.  So a text is
split at these spaces, the ids of each distinct word come from the tokenizer
once, and whole batches are put together by array gathers.  Texts in which a
space stands before white space or at the end go to the tokenizer as they are.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r" (?=\s|$)")


class Words(dict):
    """Number of each word seen; a new word is encoded and numbered.  Ids are held as bytes."""

    def __init__(self, encode, dtype):
        super().__init__()
        self.encode = encode
        self.dtype = dtype
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, text: str) -> int:
        """Number of a text that is not looked up again."""
        ids = self.encode(text)
        self.ids.append(np.array(ids, self.dtype).tobytes())
        self.held += len(ids)
        return len(self.ids) - 1

    def __missing__(self, word: str) -> int:
        k = self[word] = self.add(word)
        return k

    def learn(self, words: list[str], bytes_of: np.ndarray) -> None:
        """Number new words that begin with a space, encoded in one go: no token spans two of them."""
        if not words:
            return
        ids = np.array(self.encode("".join(words)), np.int64)
        ends = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(np.cumsum(bytes_of[ids]), ends) + 1
        data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        cuts = [0, *(last * width).tolist()]
        self.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.ids += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        self.held += len(ids)


class Tokenizer:
    """Words are remembered until there are ``memory`` of them, or five times as many ids."""

    def __init__(self, path: str, memory: int = 400_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self._encoding.encode_ordinary
        self.vocabulary = max(ranks.values()) + 1
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.bytes_of = np.zeros(self.vocabulary, np.int32)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self.memory = memory
        self.words = Words(self.encode, self.dtype)
        self.tokens = {i: t for t, i in ranks.items()}

    def decode(self, ids) -> str:
        return b"".join(self.tokens[int(i)] for i in ids).decode("utf-8", "replace")

    def encode_rows(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the rows' bounds among them; a null row has none."""
        if len(self.words.ids) > self.memory or self.words.held > 5 * self.memory:
            self.words = Words(self.encode, self.dtype)
        known = self.words
        parts: list[str] = []
        whole: list[tuple[int, str]] = []  # texts that are encoded as they are, with their places
        count: list[int] = []
        for text in arr.to_pylist():
            if not text:
                count.append(0)
            elif "\0" in text or _UNSAFE.search(text):
                whole.append((len(parts), text))
                parts.append("")
                count.append(1)
            else:
                found = text.replace(" ", "\0 ").split("\0")
                if not found[0]:
                    del found[0]
                parts += found
                count.append(len(found))
        distinct = set(parts).difference(known, ("",))
        known.learn([w for w in distinct if w[0] == " "], self.bytes_of)
        known[""] = 0  # stands for texts that are encoded whole, numbered below
        at = list(map(known.__getitem__, parts))  # a text's first word is looked up, or learned, by itself
        del known[""]
        for place, text in whole:
            at[place] = known.add(text)
        used, where = np.unique(np.array(at, np.int32), return_inverse=True)
        lists = self.words.ids
        chosen = [lists[k] for k in used.tolist()]
        size = np.fromiter(map(len, chosen), np.int64, len(chosen)) // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(chosen), self.dtype)
        begin = np.cumsum(size) - size
        length = size[where]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        step = np.repeat(begin[where] - (ends - length), length)
        ids = flat[step + np.arange(total)]
        word_bounds = np.concatenate(([0], np.cumsum(count)))
        return ids, np.concatenate(([0], ends))[word_bounds]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a process and path."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]
