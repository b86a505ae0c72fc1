"""Roman numerals."""

from __future__ import annotations

import re

_VALUE = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
_PAIR = {"IV": 4, "IX": 9, "XL": 40, "XC": 90, "CD": 400, "CM": 900}
_STEP = re.compile("|".join([*_PAIR, *_VALUE]))
_LONE = {"CD", "XL", "L", "M", "I", "C", "X", "V", "D", "XXX"}
_RUN = re.compile(r"([IVXLCDM])\1{3}")


def to_int(numeral: str, forced: bool = False) -> int | None:
    """Value of a numeral, or None where it isn't read as one.

    Unless forced, lone letters, a few ambiguous pairs and runs of four equal
    letters are no numerals.  Values must not rise from left to right.
    """
    if not numeral or not re.fullmatch(r"[IVXLCDM]+", numeral):
        return None
    if not forced and (numeral in _LONE or _RUN.search(numeral)):
        return None
    total, before = 0, 10**6
    for m in _STEP.finditer(numeral):
        value = _PAIR.get(m[0]) or _VALUE[m[0]]
        if value > before:
            return None
        total, before = total + value, value
    return total


def decimal(numeral: str, forced: bool = False) -> str:
    """Decimal digits, or the text itself where it isn't read as a numeral."""
    value = to_int(numeral, forced)
    return numeral if value is None else str(value)


def from_int(n: int) -> str:
    out = ""
    for value, sign in sorted([(v, k) for k, v in {**_VALUE, **_PAIR}.items()], reverse=True):
        count, n = divmod(n, value)
        out += sign * count
    return out
