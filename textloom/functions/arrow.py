"""Text functions over Arrow batches: one call to Python a batch, equal texts once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of results that are Python strings at a time; the texts of a batch stay in Arrow's buffers.
SENT = 1 << 18


def parts(texts: pa.Array, step: Callable[[str], str | None]) -> Iterator[pa.Array]:
    """The texts under a step, in order, each part sent before the next is made.

    A text that comes again in the batch isn't computed again: its result is kept
    up to the last place of its hash.
    """
    last = {hash(x.as_py()): k for k, x in enumerate(texts)}
    kept: dict[int, tuple[int, pa.StringScalar]] = {}
    out: list[str | None] = []
    chars = 0
    for k, x in enumerate(texts):
        t, new = x.as_py(), None
        if t is not None:
            h = hash(t)
            first, made = kept.get(h, (k, None))
            if first != k and texts[first].as_py() == t:
                new = made.as_py()
            else:
                new = step(t)
                if first == k < last[h]:
                    kept[h] = k, pa.scalar(new, pa.string())
            if last[h] == k:
                kept.pop(h, None)
        out.append(new)
        chars += len(new or "")
        if chars >= SENT:
            yield pa.array(out, pa.string())
            out, chars = [], 0
    if out:
        yield pa.array(out, pa.string())


def mapped(texts: pa.Array, step: Callable[[str], str | None]) -> pa.Array:
    """All parts in one."""
    return pa.concat_arrays([pa.array([], pa.string()), *parts(texts, step)])


def text_function(step: Callable[[str], str | None]) -> Callable[[Column | str], Column]:
    """A column function of a text-to-text step; null stays null.

    Results leave the worker part by part, so it holds a batch of texts but never one of results.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if isinstance(batches, pa.Array):  # called outside Spark
            return mapped(batches, step)
        return (part for texts in batches for part in parts(texts, step))

    return run


def chain(*steps: Callable[[str], str]) -> Callable[[str], str]:
    """Steps fused into one, so that a text crosses to Python once."""

    def run(text: str) -> str:
        for step in steps:
            text = step(text)
        return text

    return run
