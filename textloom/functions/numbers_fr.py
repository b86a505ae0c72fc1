"""French wording of numbers and ordinals, as pure functions."""

from __future__ import annotations

import re

_SMALL = ["zéro", *"un deux trois quatre cinq six sept huit neuf dix".split(), *"onze douze treize quatorze quinze seize".split()]
_SMALL += ["dix-" + _SMALL[n] for n in (7, 8, 9)]
_TENS = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante", 7: "soixante", 8: "quatre-vingt", 9: "quatre-vingt"}
_GREAT = {2: "million", 3: "milliard", 4: "billion", 6: "trillion", 8: "quatrillion", 10: "quintillion", 12: "sextillion"}
_NUMBER = re.compile(r"([+-]?)(\d*)(?:\.(\d*))?(?:[Ee]([+-]?\d+))?")


def _below_hundred(n: int, final: bool = True) -> str:
    if n < 20:
        return _SMALL[n]
    tens, units = divmod(n, 10)
    if tens in (7, 9):
        units += 10
    if n == 80:
        return "quatre-vingts" if final else "quatre-vingt"
    if units == 0:
        return _TENS[tens]
    if (units == 1 and tens < 8) or n == 71:
        return f"{_TENS[tens]} et {_SMALL[units]}"
    return f"{_TENS[tens]}-{_SMALL[units]}"


def _below_thousand(n: int, final: bool) -> str:
    hundreds, rest = divmod(n, 100)
    words = []
    if hundreds:
        words.append(("" if hundreds == 1 else _SMALL[hundreds] + " ") + "cent" + ("s" if hundreds > 1 and not rest and final else ""))
    if rest:
        words.append(_below_hundred(rest))
    return " ".join(words)


def _whole(n: int | str) -> str:
    digits = str(n)
    groups = [int(digits[max(0, k - 3) : k]) for k in range(len(digits), 0, -3)]
    if not any(groups):
        return _SMALL[0]
    words = []
    for place in range(len(groups) - 1, -1, -1):
        g = groups[place]
        if not g:
            continue
        if not (g == 1 and place == 1):
            words.append(_below_thousand(g, place == 0))
        if place == 1:
            words.append("mille")
        elif place in _GREAT:
            words.append(_GREAT[place] + ("s" if g > 1 else ""))
        elif place > 1:
            low = max(p for p in _GREAT if p < place and (place - p) in _GREAT or p == 2)
            words.append(_GREAT.get(place - low, "mille") + ("s" if g > 1 and place - low > 1 else "") + f" de {_GREAT[low]}s")
    return " ".join(words)


def cardinal(text: str | None) -> str | None:
    """``1980`` -> mille neuf cent quatre-vingts; texts with two marks come back as they are."""
    if text is None:
        return None
    if not re.search(r"\d", text) or len(re.findall(r"[.,]", text)) > 1:
        return text
    m = _NUMBER.fullmatch(text.replace(",", "."))
    if not m:
        return None
    if m[4] is not None:
        return cardinal(format(float(m[0]), "f").rstrip("0").rstrip("."))
    whole, fraction = m[2] or "0", (m[3] or "").rstrip("0")
    sign = ["moins"] if m[1] == "-" and (whole.strip("0") or fraction) else []
    if not fraction:
        return " ".join([*sign, _whole(whole)])
    words = [*sign, _whole(whole), "virgule"]
    digits = fraction.lstrip("0")
    if len(digits) < len(fraction):
        power = ordinal("1" + "0" * (len(fraction) - len(digits)))
        words.append(f"{_whole(digits)} {power}" + ("s" if digits != "1" else ""))
    else:
        words.append(_whole(digits))
    return " ".join(words)


def ordinal(text: str | None) -> str | None:
    """``21`` -> vingt et unième; None where the text is no positive number."""
    whole = str(text)
    if not (whole.isascii() and whole.isdecimal()):
        try:
            whole = str(int(float(whole.replace(",", "."))))
        except (ValueError, OverflowError):
            return None
    whole = whole.lstrip("0")
    if not whole or whole.startswith("-"):
        return None
    if whole == "1":
        return "premier"
    words = _whole(whole)
    if words.endswith("cinq"):
        words += "u"
    elif words.endswith("neuf"):
        words = words[:-1] + "v"
    words = re.sub(r"e$", "", words) + "ième"
    return words.replace("vingtsième", "vingtième").replace("centsième", "centième")


def hyphenated(n: int) -> str | None:
    """The style with ``et`` between hyphens (vingt-et-un), below a thousand million."""
    if not 0 <= n < 10**9:
        return None
    return _whole(n).replace(" et ", "-et-")


def year(text: str) -> str:
    """1984 -> dix-neuf cent quatre-vingt-quatre; other years as numbers."""
    if len(text) == 4 and text.isdigit() and "11" <= text[:2] <= "19":
        tail = "" if text[2:] == "00" else " " + _below_hundred(int(text[2:]))
        return f"{_SMALL[int(text[:2])]} cent{tail}"
    return cardinal(text) or text
