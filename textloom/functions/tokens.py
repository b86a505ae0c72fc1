"""Tokenisation of English and French text: words and marks apart by blanks."""

from __future__ import annotations

import re

from textloom.functions.cleaning import fold_greek, fold_latin
from textloom.functions.lexicon import ABBREVIATIONS
from textloom.functions.patterns import CAPITAL, CAPITAL_OR_DIGIT, compiled, fixpoint, sub

_OPERATORS = "+=÷×/"
_SPACED = compiled(r"([±(){}\[\]\"«»+=÷×/,;:?!¡¿])")
_DOMAIN = compiled(r"\.(?:ch|co\.uk|com|de|es|fr|gov|info|it|net|org)", re.I)
_WEB = compiled(r"(?:http://|www\.)\S+|\S+@\S+\.\S+")
_CENTURY = compiled(r"(?:17|18|19|20)\d\d")
_OPENING, _CLOSING = compiled(r"(?:(?<= )|^)'"), compiled(r"(?<=[^s\n])'(?= |\Z)")
_LETTER = r"[^\W\d_]"


def _parenthesis(m: re.Match) -> str:
    inner = m[1]
    return "  " if len(inner) <= 2 or inner.strip().isdigit() else f" ({inner}) "


def _parenthesis_fr(m: re.Match) -> str:
    return "  " if len(m[1]) <= 2 else f" ({m[1]}) "


def _year_pair(m: re.Match) -> str:
    a, b = m[1], m[2]
    return f"{a} , {b}" if _CENTURY.fullmatch(a) or _CENTURY.fullmatch(b) else m[0]


def split_dots(word: str, abbreviations: frozenset[str] = ABBREVIATIONS) -> str:
    """Where the dots of a word part from it: not in numbers, domains, abbreviations or initials."""
    if "." not in word:
        return word
    word = sub(r"\.{3,}", " ... ", word) if "..." in word else word
    if "..." in word:
        return word.strip()
    word = sub(r"(?<=\d)\.$", " .", word)
    if word.startswith("."):
        return ". " + word[1:] if len(word) > 1 else word
    if _DOMAIN.search(word) or compiled(r"\d\.\d").search(word) or word in abbreviations:
        return word
    if compiled(r".*[A-ZÀ-Þ]\.[A-ZÀ-Þ]\.[A-ZÀ-Þ]\.?").fullmatch(word):
        return word.replace(".", "")
    if compiled(r"[A-ZÀ-Þ]\.-[A-ZÀ-Þ]\.*|(?:[A-ZÀ-Þ]\.){1,2}").fullmatch(word):
        return word
    if compiled(r".*\w{2}\.").fullmatch(word):
        return word[:-1] + " ."
    return word if word.endswith(" .") else word.replace(".", " . ")


def _one_blank(text: str) -> str:
    return sub(r" +", " ", text) if "  " in text else text


def _word(word: str, abbreviations: frozenset[str]) -> str:
    if "." not in word:
        return word
    if _WEB.fullmatch(word):
        return word[:-1] + " ." if word.endswith(".") else word
    return split_dots(word, abbreviations)


def thousands(text: str) -> str:
    """``1,234,567`` -> ``1234567``"""
    return sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)


def quoted(text: str) -> str:
    """Blanks around the quotes of ``'some words'``; where one isn't closed, none after it in the line is."""
    if "'" not in text:
        return text
    lines = text.split("\n")
    for k, line in enumerate(lines):
        out, at = [], 0
        first = _OPENING.search(line)
        while first and (last := _CLOSING.search(line, first.end() + 1)):
            out += line[at : first.start()], f" ' {line[first.end() : last.start()]} ' "
            at = last.end()
            first = _OPENING.search(line, at)
        if out:
            lines[k] = "".join(out) + line[at:]
    return "\n".join(lines)


def year_pairs(text: str, conjunctions: str = "and|or") -> str:
    """Commas in lists of numbers and between years stand apart."""
    text = sub(
        rf"\b\d+(?:,\d+){{2,}}(?= +(?:{conjunctions}) \d)", lambda m: m[0].replace(",", " , "), text
    )
    return sub(r"\b(\d+),(\d+)\b", _year_pair, text)


def calm(text: str) -> str:
    """Runs of three or more shouted words in small letters, the first capitalised."""

    def down(m: re.Match) -> str:
        first, _, rest = m[0].partition(" ")
        return f"{first.capitalize()} {rest.lower()}"

    shouted = "['A-Z0-9-]"
    return sub(rf"(?:(?<= )|^){CAPITAL}{shouted}*(?: {CAPITAL_OR_DIGIT}{shouted}*(?: ,)?)+ {CAPITAL}{shouted}+", down, text)


def tokenize(text: str, lang: str = "en", abbreviations: frozenset[str] = ABBREVIATIONS) -> str:
    """Tokens of each line, apart by one blank; lines without tokens are dropped."""
    text = fold_greek(text)
    if lang == "en":
        text = fold_latin(text)
    text = text.replace("’", "'").replace("…", "...").replace("|", " ")
    text = sub(r"^ ?\d+(?:[-.:/\\]\d+)+: ?", "", text)
    text = sub(r"</?[^<>\n]+>", " ", text)
    text = sub(r"[<>]{2,}", " ", text)
    text = quoted(text)
    out = []
    for line in text.split("\n"):
        line = thousands(line)
        line = line.replace("(at)", " @ ")
        line = sub(r"\(([^)]+)\)", _parenthesis if lang == "en" else _parenthesis_fr, line)
        line = sub(r" ?[■•] ?", "\n- ", line)
        line = sub(r" (?:(?:-?\d[.\d]*|[A-Za-z]) ){5,}", "\n", line)
        line = sub(r"((?:http://|www\.)\S+?)/(?=[\s,;:?!.\"«»]|$)", r"\1", line)
        line = _SPACED.sub(r" \1 ", line)
        line = sub(r"--+", " -- ", line)
        line = sub(r"Canal\s+\+", "Canal+", line)
        line = fixpoint(r"(\d) +([.,]) +(?=\d)", r"\1\2", line)
        line = year_pairs(line, "and|or" if lang == "en" else "et|ou")
        line = sub(r"(\d) +('{1,2}) *(?=\d{1,2}\b)", r"\1\2", line)
        line = sub(r"([A-ZÀ-Þ]\.[A-ZÀ-Þ]\.[A-ZÀ-Þ]\.) +(?=[A-ZÀ-Þ])", r"\1 . ", line)
        line = sub(r"http +: +/ +/ *", "http://", line)
        line = fixpoint(r"((?:http://|www\.)\S+) */ *(?=[^\s/])", r"\1/", line) if "http" in line or "www" in line else line
        for row in line.split("\n"):
            words = " ".join(_word(w, abbreviations) for w in row.split())
            if lang == "en":
                words = fixpoint(r" (?:-?[^A-Za-z\s][\d.]* )(?:-?[\d.]+ ){2,}-?[^A-Za-z\s][\d.]*", "\n", words)
                words = sub(r" \.(?: \.){2,}", " ...", words)
                words = calm(_one_blank(words))
            out += [w for w in (_one_blank(p).strip() for p in words.split("\n")) if w]
    return "\n".join(out).replace("‘", "'").replace("–", "-")
