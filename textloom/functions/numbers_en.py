"""English wording of numbers, ordinals and years, as pure functions."""

from __future__ import annotations

import re

_UNITS = ["zero", *"one two three four five six seven eight nine".split()]
_TEENS = "ten eleven twelve thirteen fourteen fifteen".split() + "sixteen seventeen eighteen nineteen".split()
_TENS = dict(zip(range(20, 100, 10), "twenty thirty forty fifty sixty seventy eighty ninety".split()))
_GROUPS = ["", *(p + "illion" for p in "m b tr quadr quint sext sept oct non dec".split())]
_GROUPS.insert(1, "thousand")
_IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
_INFINITY = re.compile(r"([+-]?)inf(?:inity)?", re.I)
_SCIENCE = re.compile(r"([+-]?(?:[,\d]*\.\d+|[,\d]+))[Ee](-?\d+)")
_PLAIN = re.compile(r"([-+]?)(\d*)(?:\.(\d+))?")


def _below_thousand(n: int) -> str:
    if n < 10:
        return _UNITS[n]
    if n < 20:
        return _TEENS[n - 10]
    if n < 100:
        return _TENS[n - n % 10] + (f"-{_UNITS[n % 10]}" if n % 10 else "")
    rest = n % 100
    return f"{_UNITS[n // 100]} hundred" + (f" and {_below_thousand(rest)}" if rest else "")


def _whole(digits: str) -> str:
    groups = [int(digits[max(0, k - 3) : k]) for k in range(len(digits), 0, -3)]
    if not any(groups[1:]):
        return _below_thousand(groups[0])
    parts, last = [], groups[0]
    for place, group in enumerate(groups):
        if group:
            if place < len(_GROUPS):
                name = _GROUPS[place]
            else:
                name = f"times ten to the {ordinal(str(3 * place))}"
            parts.append(f"{_below_thousand(group)} {name}".strip())
    parts.reverse()
    if 0 < last < 100 and len(parts) > 1:
        parts[-2] += " and"
        return " ".join(parts) if len(parts) == 2 else ", ".join(parts)
    return " ".join(parts) if len(parts) == 2 else ", ".join(parts)


def cardinal(text: str | None) -> str | None:
    """``221`` -> two hundred and twenty-one; None where the text is no number."""
    if not text:
        return None
    if text == "NaN":
        return "not-a-number"
    m = _INFINITY.fullmatch(text)
    if m:
        return {"+": "positive ", "-": "negative ", "": ""}[m[1]] + "infinity"
    m = _SCIENCE.fullmatch(text)
    if m:
        return f"{cardinal(m[1])} times ten to the {ordinal(m[2])}"
    m = _PLAIN.fullmatch(text.replace(",", ""))
    if not m or not (m[2] or m[3]):
        return None
    words = [{"-": "negative", "+": "positive", "": ""}[m[1]]]
    if m[2]:
        words.append(_whole(m[2]))
    if m[3]:
        words.append("point")
        if len(m[3]) == 2 and m[3][0] != "0":
            words.append(_below_thousand(int(m[3])))
        else:
            words += [_UNITS[int(d)] for d in m[3]]
    return " ".join(w for w in words if w)


def ordinal(text: str | None) -> str | None:
    """``21`` -> twenty-first."""
    words = cardinal(text)
    if not words:
        return words
    m = re.search(r"\w+$", words)
    if not m:
        return words + "th"
    last = m[0]
    new = _IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return words[: m.start()] + new


def year(text: str) -> str:
    """A year read in pairs where English does: 1984 -> nineteen eighty-four."""
    if len(text) == 4 and text.isdigit():
        head, tail = text[:2], text[2:]
        if text == "2000":
            return "two thousand"
        if head == "20":
            return "two thousand " + (cardinal(str(int(tail))) or "")
        if head in ("13", "14", "15", "16", "17", "18", "19"):
            if tail == "00":
                return f"{cardinal(head)} hundred"
            if tail[0] == "0":
                return f"{cardinal(head)} zero {cardinal(tail[1])}"
            return f"{cardinal(head)} {cardinal(tail)}"
    return cardinal(text) or text


def plural(n: str | float) -> str:
    """The s of a regular plural."""
    try:
        value = float(str(n).replace(",", ""))
    except ValueError:
        return "s"
    return "" if -2 < value < 2 else "s"
