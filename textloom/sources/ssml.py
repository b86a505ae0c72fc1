"""SSML documents as rows of utterance items.

``speak``, ``p`` and ``s`` bound utterances; ``sub`` gives way to its alias;
``phoneme`` adds its phonemes, linked to the words it holds; ``break`` adds a
filler with a duration in seconds; other elements give their text.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, utterance int, sequence string, item int, value string, first_word int, last_word int"
_BOUNDS = {"speak", "p", "s"}


def seconds(time: str) -> float:
    """``250ms`` or ``1.5s`` in seconds; nothing else is a time."""
    m = re.fullmatch(r"(\d+(?:[.]\d+)?)(m?s)", time or "0s")
    if not m:
        raise ValueError(f"a break's time is in s or ms, not {time}")
    return float(m[1]) / (1000 if m[2] == "ms" else 1)


def items(xml: str, prepare: Callable[[str], str] = str) -> list[tuple[int, str, int, str, int | None, int | None]]:
    """utterance, sequence, item, value, and the words it is linked to."""
    out: list[tuple] = []
    state = {"utterance": 0, "word": 0, "phoneme": 0, "filler": 0, "duration": 0}

    def next_utterance() -> None:
        if state["word"] or state["filler"]:
            state.update(utterance=state["utterance"] + 1, word=0, phoneme=0, filler=0, duration=0)

    def add(kind: str, value: str, first: int | None = None, last: int | None = None) -> None:
        out.append((state["utterance"], kind, state[kind], value, first, last))
        state[kind] += 1

    def words(text: str | None) -> tuple[int, int]:
        begin = state["word"]
        for w in prepare(text or "").split():
            add("word", w)
        return begin, state["word"] - 1

    def walk(node: ET.Element) -> None:
        name = node.tag.rpartition("}")[2]
        if name in _BOUNDS:
            next_utterance()
        if name == "sub":
            if not node.get("alias"):
                raise ValueError("sub needs an alias")
            words(node.get("alias"))
        elif name == "break":
            add("filler", "silence")
            add("duration", str(seconds(node.get("time") or "0s")), state["word"], state["word"])
        elif name == "phoneme":
            if not node.get("ph"):
                raise ValueError("phoneme needs ph")
            first, last = words("".join(node.itertext()))
            for p in node.get("ph").split():
                add("phoneme", p, first, last if last >= first else first)
        else:
            words(node.text)
            for child in node:
                walk(child)
                words(child.tail)
        if name in _BOUNDS:
            next_utterance()

    walk(ET.fromstring(xml))
    return out


def read_ssml(df: DataFrame, key: str, column: str, prepare: Callable[[str], str] = str) -> DataFrame:
    """Rows of utterance items of each document; documents that are no SSML fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, *item)
                for k, xml in zip(batch[0].to_pylist(), batch[1].to_pylist())
                if xml
                for item in items(xml, prepare)
            ]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            cols = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return df.select(F.col(key).cast("long"), column).mapInArrow(run, SCHEMA)
