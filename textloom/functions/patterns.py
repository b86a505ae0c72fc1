"""Token edges and character sets that the text rewrites share.

A token begins at the start of a line or after a blank and ends before a blank,
a line feed, the end, or a genitive that a blank follows.  Both edges are
look-arounds, so neighbouring tokens never compete for the blank between them.
"""

from __future__ import annotations

import functools
import re
import re._constants as sre
from collections.abc import Callable

UP = "A-ZÀ-ÖØ-Þ"
LO = "a-zß-öø-ÿ"
BEGIN = r"(?<![^ \n])"
END = r"(?= |\n|\Z|'[sS]? )"
NUMBER = r"\d+(?:[.,/]\d+)*"
YEAR_MARK = "\ue000"
ROMAN_MARK = "ROMAN_CARDINAL"
TAGS = ("CURRENCY", "DATE", "LOCATION", "ORGANIZATION", "PERSON", "PHONE", "QUANTITY", "TIME", "URL")
HOUR = r"(?:[01]?\d|2[0-4])"
MINUTE = r"[0-5]\d"
COLON = r"(?:\.| *: *)"
CAPITAL, LETTER, CAPITAL_OR_DIGIT = "[A-Z]", "[a-z]", "[A-Z0-9]"
NAME = f"{CAPITAL}{LETTER}{{2,}}"
NUMERAL = "[IVXLCDM]"
MODERN = r"(?:1[6-9]|20)\d\d"
AFTER = r"(?= |\n|\Z)"
HALVES = "(.+-|)(.+?)-(.+"

Rewrite = str | Callable[[re.Match], str]


@functools.lru_cache(4096)
def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags | re.M)


_DIGITS = frozenset("0123456789")


def _choices(items) -> frozenset[str] | None:
    """Characters that a class may match, or None where they are too many to list."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < 64:
            out.update(map(chr, range(value[0], value[1] + 1)))
        elif op is sre.CATEGORY and value is sre.CATEGORY_DIGIT:
            out |= _DIGITS
        else:
            return None
    return frozenset(out)


def _required(tree) -> set[frozenset[str]]:
    """Sets of characters, each of which gives one to every match or its surroundings."""
    out: set[frozenset[str]] = set()
    for op, value in tree:
        if op is sre.LITERAL:
            out.add(frozenset(chr(value)))
        elif op is sre.IN:
            found = _choices(value)
            if found:
                out.add(found)
        elif op is sre.SUBPATTERN:
            out |= _required(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            out |= _required(value[2])
        elif op is sre.ASSERT:
            out |= _required(value[1])
        elif op is sre.BRANCH:
            parts = [_required(b) for b in value[1]]
            if all(parts):
                out.add(frozenset().union(*(min(p, key=len) for p in parts)))
    return out


@functools.lru_cache(4096)
def required(pattern: str, flags: int = 0) -> tuple[frozenset[str], ...]:
    """What a text must hold for the pattern to match; letters count in one case only where the case matters."""
    found = _required(re._parser.parse(pattern, flags | re.M))
    if flags & re.I or "(?i" in pattern:
        found = {s for s in found if not any(c.isalpha() for c in s)}
    return tuple(sorted((s for s in found if " " not in s and len(s) <= 80), key=len))[:4]


_last: list = ["", frozenset(), None]
_split: list = ["", frozenset()]


def characters(text: str) -> frozenset[str]:
    """The characters of a text, with 0 for any digit; the last text's are kept."""
    if _last[0] is not text:
        found = frozenset(text)
        if not text.isascii() and any(c.isdigit() for c in found):
            found |= _DIGITS
        _last[:] = text, found, None
    return _last[1]


def _small(text: str) -> str:
    """The last text in small letters, which are kept."""
    if _last[0] is not text:
        return text.lower()
    if _last[2] is None:
        _last[2] = text.lower()
    return _last[2]


def pieces(text: str) -> frozenset[str]:
    """What stands between blanks and line feeds; the last text's are kept."""
    if _split[0] is not text:
        _split[:] = text, frozenset(text.replace("\n", " ").split(" "))
    return _split[1]


#: Of characters that match an ASCII letter where case doesn't matter, those that aren't its other case.
_ODD_CASE = frozenset("İıſ\u212aµ")
_PRODUCT, _STRINGS = 12, 8


def _single(op, value) -> frozenset[str] | None:
    """The few characters that one element matches."""
    if op is sre.LITERAL:
        return frozenset(chr(value))
    if op is sre.IN:
        found = _choices(value)
        return found if found and len(found) <= 4 else None
    return None


def _strings(tree) -> list[frozenset[str]]:
    """Sets of strings, one of each of which every match holds."""
    out: list[frozenset[str]] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        if run != {""}:
            out.append(frozenset(run))
        run = {""}

    def walk(part) -> None:
        nonlocal run
        for op, value in part:
            if op in (sre.AT, sre.ASSERT_NOT):
                continue
            if op is sre.ASSERT:
                if value[0] > 0:
                    out.extend(_strings(value[1]))
                continue
            one = _single(op, value)
            if one is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0 and len(value[2]) == 1:
                one = _single(*value[2][0])
                if one and len(run) * len(one) <= _PRODUCT:
                    run = {r + c for r in run for c in one}
                flush()
                continue
            if one and len(run) * len(one) <= _PRODUCT:
                run = {r + c for r in run for c in one}
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                walk(value[-1])
            elif op is sre.BRANCH:
                flush()
                best = [min(_strings(b), key=lambda x: (-min(map(len, x)), len(x)), default=None) for b in value[1]]
                if all(best):
                    out.append(frozenset().union(*best))
            else:
                flush()
                if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                    out.extend(_strings(value[2]))

    walk(tree)
    flush()
    return out


#: Starts of patterns, and the characters after which they hold besides a text's start.
_EDGES = ((BEGIN, r"[ \n]"), (r"(?:(?<= )|^)", r"[ \n]"), (r"(?:(?<=[ -])|^)", r"[ \n-]"))


class Plan:
    """A pattern with what tells quickly that a text holds no match.

    ``need``: characters; ``hold``: strings, one of each set of which any match holds;
    ``after``: the pattern behind the blank that has to precede it, for a search from
    blank to blank.
    """

    __slots__ = ("find", "need", "hold", "small", "after")

    def __init__(self, pattern: str, flags: int):
        tree = re._parser.parse(pattern, flags | re.M)
        self.find = compiled(pattern, flags)
        self.need = required(pattern, flags)
        self.small = bool(flags & re.I or "(?i" in pattern)
        held = {frozenset(x.lower() for x in h) if self.small else h for h in _strings(tree)}
        held = sorted((h for h in held if min(map(len, h)) > 1 and len(h) <= _STRINGS), key=lambda h: (len(h), -min(map(len, h)), sorted(h)))
        self.hold = tuple(tuple(sorted(h)) for h in held[:3])
        self.after = None
        for edge, before in _EDGES:
            whole = len(tree) == 1 and tree[0][0] is sre.BRANCH
            if pattern.startswith(edge) and not whole and tree.getwidth()[0] > 0 and "(?P" not in pattern:
                self.after = re.compile(f"{before}(?:{pattern[len(edge) :]})", flags | re.M)

    def absent(self, text: str) -> bool:
        """Is it plain that the pattern has no match?"""
        have = characters(text)
        for need in self.need:
            if have.isdisjoint(need):
                return True
        if self.hold:
            if self.small:
                if not have.isdisjoint(_ODD_CASE):
                    return False
                text = _small(text)
            for strings in self.hold:
                for x in strings:
                    if x in text:
                        break
                else:
                    return True
        return False


plan = functools.lru_cache(4096)(Plan)


def holds(pattern: str, text: str, flags: int = 0) -> bool:
    """Does the pattern match anywhere?"""
    p = plan(pattern, flags)
    if p.absent(text):
        return False
    if p.after:
        return bool(p.find.match(text) or p.after.search(text))
    return bool(p.find.search(text))


def sub(pattern: str, new: Rewrite, text: str, flags: int = 0) -> str:
    """All matches replaced; texts that can't hold one aren't searched."""
    p = plan(pattern, flags)
    if p.absent(text):
        return text
    if p.after is None:
        return p.find.sub(new, text)
    match, search = p.find.match, p.after.search
    m = match(text)
    if m is None:
        found = search(text)
        if found is None:
            return text
        m = match(text, found.start() + 1)
    say = new if callable(new) else new if "\\" not in new else lambda x: x.expand(new)
    out, at = [], 0
    while m is not None:
        out += text[at : m.start()], say(m) if callable(say) else say
        at = m.end()
        found = search(text, at - 1)
        m = match(text, found.start() + 1) if found else None
    out.append(text[at:])
    return "".join(out)


def fixpoint(pattern: str, new: Rewrite, text: str) -> str:
    """Replace until nothing changes."""
    while True:
        after = sub(pattern, new, text)
        if after == text:
            return text
        text = after


def trim_blanks(text: str) -> str:
    """Runs of blanks become one; lines neither begin nor end with one."""
    while "  " in text:
        text = text.replace("  ", " ")
    text = text.replace("\n ", "\n")
    text = (text[1:] if text.startswith(" ") else text).replace(" \n", "\n")
    return text[:-1] if text.endswith(" ") else text


def tag(name: str, body: str) -> str:
    return f" <{name}> {body.strip()} </{name}> "


def alternation(words) -> str:
    """Longest first, so that a prefix never hides a longer word."""
    return _alternation(tuple(words))


@functools.lru_cache(256)
def _alternation(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
