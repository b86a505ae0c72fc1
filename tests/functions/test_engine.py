"""Replacements skip texts without a match, and give what plain regular expressions give."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from textloom.functions import patterns
from textloom.functions.arrow import mapped
from textloom.functions.patterns import BEGIN, END

EDGE = r"(?:(?<= )|^)"


@pytest.mark.parametrize(
    "pattern, new",
    [
        (rf"{BEGIN}([ab])\.?{END}", r"<\1>"),
        (rf"{BEGIN}a b ", "x"),
        (rf"{EDGE}(a+)-(?=b)", lambda m: m[1].upper()),
        (rf"{EDGE}a|b", "y"),
        (r"(?:(?<=[ -])|^)(?:a|bb)+(?! )", r"[\g<0>]"),
        (r"(?:a\.b|ab\b)(?=-| )", "z"),
        (rf"{BEGIN}(?<!a )b'?s", "q"),
    ],
)
@pytest.mark.parametrize("flags", [0, re.I])
def test_as_plain_expressions(pattern, new, flags):
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices("aabAB .-'s\n", k=draw.randint(0, 14)))
        assert patterns.sub(pattern, new, text, flags) == re.sub(pattern, new, text, flags=flags | re.M), text


def test_texts_without_a_needed_string_are_skipped():
    assert patterns.plan(rf"{BEGIN}(noon|midnight){END}", re.I).absent("the night is young, no one")
    assert not patterns.plan(rf"{BEGIN}(noon|midnight){END}", re.I).absent("at MIDNIGHT")
    assert not patterns.plan(r"\d{2} kilos", re.I).absent("55 \u212aILOS")  # a Kelvin sign counts as a k
    assert patterns.sub(r"\d{2} kilos", "x", "55 \u212aILOS", re.I) == "x"


def test_blanks_trimmed():
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choices("a  \n", k=draw.randint(0, 12)))
        plain = re.sub(" $", "", re.sub("^ ", "", re.sub("  +", " ", text), flags=re.M), flags=re.M)
        assert patterns.trim_blanks(text) == plain


def test_a_batch_is_never_held_as_strings():
    texts = pa.array([f"{k % 1500} " + "x" * 20_000 for k in range(2000)] + [None])
    calls = []
    tracemalloc.start()
    try:
        out = mapped(texts, lambda t: calls.append(1) or t.upper())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8e6  # of 40 MB
    assert len(calls) == 1500 and out[-1].as_py() is None
    assert [out[k].as_py()[:6] for k in (3, 1503)] == ["3 XXXX"] * 2
