"""Options of specific normalisation, applied in the order of a configuration.

Options that need Python, and those before them that are as simple there, share one
Arrow function; the others are expressions that run in the JVM.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import numbers_en, numbers_fr
from textloom.functions.arrow import chain, text_function
from textloom.functions.patterns import CAPITAL_OR_DIGIT, TAGS, alternation, compiled, sub, trim_blanks
from textloom.operators import columns, rules

_NOTHING = {
    "PUNCTUATION_ON",
    "TAGS_INLINE",
    "HYPHENS_ON",
    "ACRONYMS_DOTTED",
    "LETTER_DOTS_ON",
    "SAXON_GENITIVES_JOINT",
    "SAXON_GENITIVES_JOINT_IF_POSSIBLE",
    "SPELLING_AMERICAN",
    "CASE_ON",
}
_COLUMN: dict[str, Callable[[Column], Column]] = {
    "PUNCTUATION_OFF": columns.punctuation_off,
    "WEAK_PUNCTUATION_OFF": columns.weak_punctuation_off,
    "BREAK_LINES": columns.break_lines,
    "TAGS_ON": columns.tags_on,
    "TAGS_OFF": columns.tags_off,
    "HYPHENS_OFF": columns.hyphens_off,
    "HYPHENS_INTERNAL": columns.hyphens_internal,
    "ACRONYMS_JOINT": columns.acronyms_joint,
    "LETTER_DOTS_OFF": columns.letter_dots_off,
    "CASE_OFF": columns.case_off,
    "CASE_LOW": columns.case_low,
}
_PYTHON = {"ACRONYMS_EXPLODED", "ACRONYMS_EXPLODED_UNLESS_READABLE", "SPELLING_BRITISH"}
#: Of the others, those that are done in Python where such a one follows without others between.
_BEFORE: dict[str, Callable[[str], str]] = {
    "TAGS_OFF": lambda t: trim_blanks(sub(r" ?</?[A-Z]+> ?", " ", t)).replace(" 's", "'s"),
    "HYPHENS_OFF": lambda t: t.replace("-", " "),
}
_ALIAS = {
    "TAG_ON": "TAGS_ON",
    "ACRONYMS_READABLE_JOINT": "ACRONYMS_EXPLODED_UNLESS_READABLE",
    "ACRONYMS_READABLE_EXPLODED": "ACRONYMS_DOTTED",
}

PRESETS = {
    "asr": "TAGS_OFF SPELLING_BRITISH HYPHENS_OFF SAXON_GENITIVES_JOINT ACRONYMS_EXPLODED_UNLESS_READABLE LETTER_DOTS_ON CASE_OFF PUNCTUATION_OFF BREAK_LINES",
    "g2p": "TAGS_OFF HYPHENS_ON ACRONYMS_EXPLODED CASE_LOW SAXON_GENITIVES_JOINT",
    "indexing": "TAGS_OFF SPELLING_BRITISH HYPHENS_OFF SAXON_GENITIVES_JOINT ACRONYMS_DOTTED LETTER_DOTS_ON CASE_OFF PUNCTUATION_OFF",
    "nlp": "TAGS_OFF SPELLING_BRITISH HYPHENS_ON SAXON_GENITIVES_JOINT ACRONYMS_DOTTED LETTER_DOTS_ON CASE_ON PUNCTUATION_ON",
    "tts": "TAGS_OFF SPELLING_BRITISH HYPHENS_OFF SAXON_GENITIVES_JOINT ACRONYMS_EXPLODED_UNLESS_READABLE LETTER_DOTS_OFF CASE_OFF PUNCTUATION_ON BREAK_LINES",
}
PRESETS = {k: v.split() for k, v in PRESETS.items()}

_VOWEL = "[AEIOUY]"
_READABLE = re.compile(f"(?:(?:{'|'.join(columns.ONSETS)})?{_VOWEL}{_VOWEL}?)+(?:{'|'.join(columns.CODAS)})?")


def pronounceable(word: str) -> bool:
    bare = word.replace(".", "")
    return 3 <= len(bare) <= 6 and bool(_READABLE.fullmatch(bare))


@dataclasses.dataclass(frozen=True)
class Spoken:
    """Words of a language in which signs and digits of acronyms are said."""

    say: Callable[[str], str]
    both: str
    zero: str
    point: str
    times: tuple[str, str, str]  # of four, three and two equal digits


SPOKEN = {
    "en": Spoken(numbers_en.cardinal, "AND", "zero", "point", ("four", "triple", "double")),
    "fr": Spoken(numbers_fr.cardinal, "ET", "zéro", "point", ("quatre", "trois", "deux")),
}


def explode_acronym(word: str, lang: str = "en") -> str:
    """``P.C.A.`` -> ``P. C. A.``; equal digits as double, triple or four, others in words."""
    said = SPOKEN[lang]
    say, both = said.say, said.both
    x = word.replace("&", f" {both} ")
    for n, name in zip((4, 3, 2), said.times):
        x = sub(rf"(\d)\1{{{n - 1}}}", lambda m, name=name: f" {name} {m[1]} ", x)
    x = sub(r"(\d)\.(?=\d)", rf"\1 {said.point} ", x)

    def zeros(m: re.Match) -> str:
        head, out = m[0], []
        while (k := head.rfind("0", 1, len(head) - 1)) > 0:
            out.append(f" {said.zero} {say(head[k + 1])} {head[k + 2 :]}")
            head = head[:k]
        return head + "".join(reversed(out))

    def pairs(m: re.Match) -> str:
        head = 2 - len(m[0]) % 2
        return m[0][:head] + "".join(f" {say(m[0][k : k + 2])} " for k in range(head, len(m[0]), 2))

    x = sub(r"\d{3,}", pairs, sub(r"\d{3,}", zeros, x))
    x = sub(r"0(\d)", lambda m: f" {said.zero} {say(m[1])} ", x)
    x = sub(r"\d\d?", lambda m: f" {say(m[0])} ", x)
    x = sub(r"ty s$", "ties", x) if lang == "en" else x
    x = sub(r"([A-Za-z]\.)(?! )", r"\1 ", x)
    x = sub(rf"([A-Z])(?![A-Za-z.])(?!{both[1:]}\b)", r"\1.", x) if not compiled(rf"\b{both}\b").search(x) else x
    x = sub(r"(?<![A-Za-z])([A-Z]{2,5})(?![A-Za-z.])", lambda m: m[0] if m[0] == both else " ".join(c + "." for c in m[0]), x)
    x = sub(r"(?:(?<= )|^)([a-z]) ", lambda m: m[1].upper() + ". ", x)
    x = sub(r" +", " ", sub(r"-+", " ", x) if lang == "en" else sub(r"(?<=[A-Z0-9.])-+|-+(?=[A-Z0-9])", " ", x)).strip()
    return sub(r" s$", "s", x)


#: Each text can be read in one way only: with several, a long key would be tried in exponentially many.
_ACRONYM = rf"(?:(?<= )|^){CAPITAL_OR_DIGIT}[.]?(?:[&-]?{CAPITAL_OR_DIGIT}[.]?)+(?='s|s|'| |\n|\Z)"
_MIXED = r"(?:(?<= )|^)[a-z]+[-&]?\d[A-Za-z0-9-]*(?:(?:\.[-&]?|&)\d[A-Za-z0-9-]*)*\.?(?='s|s|'| |\n|\Z)"


def acronyms_exploded(text: str, lang: str = "en") -> str:
    def each(m: re.Match) -> str:
        w = m[0]
        dotted = "." in w or any(c.isdigit() for c in w) or "&" in w
        return explode_acronym(w, lang) if dotted else w

    text = sub(_ACRONYM, each, text)
    return sub(_MIXED, lambda m: explode_acronym(m[0], lang), text)


def acronyms_exploded_unless_readable(text: str, lang: str = "en") -> str:
    """Letters are peeled off until the rest can be read as a word."""

    def peel(m: re.Match) -> str:
        w, head = m[1], ""
        while len(w) > 12 or not pronounceable(w):  # at most six letters, each with a dot
            first = compiled(r"([A-Z])\.?").match(w)
            if not first:
                break
            head += first[1] + ". "
            w = w[first.end() :]
        digits = " " + explode_acronym(m[2], lang) if m[2] else ""
        return (head + w.replace(".", "")).strip() + digits

    while True:
        after = sub(r"(?:(?<= )|^)((?:[A-Z]\.){2,})(\d+)?(?=[ \n]|\Z)", peel, text)
        after = acronyms_exploded(after, lang)
        if after == text:
            return trim_blanks(text)
        text = after


def known(option: str) -> str:
    """The option's canonical name, or ValueError."""
    name = option.strip()
    if name.upper().startswith("EXTERNAL_SCRIPT="):
        return name
    name = _ALIAS.get(name.upper(), name.upper())
    m = re.fullmatch(r"TAGS?_NO_([A-Z]+)|NO_X_TAG\('?([A-Z]+)'?\)", name)
    if m and (m[1] or m[2]) in TAGS:
        return f"TAGS_NO_{m[1] or m[2]}"
    if name in _NOTHING or name in _COLUMN or name in _PYTHON or name == "SAXON_GENITIVES_EXPLODED":
        return name
    raise ValueError(f"unknown option {option}")


def read_config(text: str) -> list[str]:
    """Options of a configuration, one a line, with # comments."""
    return [known(x) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]


def protect(c: Column, words: list[str], upper: bool) -> Column:
    """Listed words between underscores, out of reach of the options."""
    flag = "(?dmi)" if upper else "(?dm)"
    return F.regexp_replace(c, rf"{flag}(?<=^|[ \n])({_java(words)})(?= |\n|$)", "_$1_") if words else c


def unprotect(c: Column, words: list[str], upper: bool) -> Column:
    flag = "(?dmi)" if upper else "(?dm)"
    return F.regexp_replace(c, rf"{flag}(?<=^|[ \n])_({_java(words)})_(?= |\n|$)", "$1") if words else c


def _java(words: list[str]) -> str:
    return alternation(words).replace("\\ ", " ")


def _python_step(name: str, upper: bool, lang: str, british: rules.RuleSet | None) -> Callable[[str], str] | None:
    """The text function of an option that is computed in Python; None for one without effect."""
    if name == "ACRONYMS_EXPLODED":
        return lambda t: acronyms_exploded(t, lang)
    if name == "ACRONYMS_EXPLODED_UNLESS_READABLE":
        return lambda t: acronyms_exploded_unless_readable(t, lang)
    if lang != "en":  # the table of spellings is of English words
        return None
    table = british or rules.swapped(rules.UK_TO_US)
    if upper:
        table = rules.RuleSet(rules.parse([f"{r.pattern} => {r.rewrite}" for r in table.rules], any_case=True))
    return table.apply


def specific(
    df: DataFrame,
    column: str,
    options: list[str],
    vocabulary: list[str] = (),
    british: rules.RuleSet | None = None,
    scripts: dict[str, Callable[[Column], Column]] | None = None,
    lang: str = "en",
    keep_paragraphs: bool = False,
) -> DataFrame:
    """The column under all options, in their order.

    Of a run of blank lines one stays, unless paragraphs are kept as they are.
    External scripts are callables from column to column, given by name: nothing
    is run in a shell.
    """
    names = [known(o) for o in options]
    upper = "CASE_OFF" in names
    c = protect(F.col(column), list(vocabulary), upper)
    names = [n for n in names if n not in _NOTHING]
    fused = [n in _PYTHON for n in names]
    for k in range(len(names) - 2, -1, -1):  # simple ones right before a fused one join it
        fused[k] |= fused[k + 1] and names[k] in _BEFORE
    steps: list[Callable[[str], str]] = []
    for name, inside in zip(names, fused):
        if inside:
            step = _BEFORE.get(name) or _python_step(name, upper, lang, british)
            steps += [step] if step else []
            continue
        if steps:
            c, steps = text_function(chain(*steps))(c), []
        if name in _COLUMN:
            c = _COLUMN[name](c)
        elif name.startswith("TAGS_NO_"):
            c = columns.tag_off(c, name[8:])
        elif name == "SAXON_GENITIVES_EXPLODED":
            c = columns.saxon_exploded(c, upper)
        elif name.upper().startswith("EXTERNAL_SCRIPT="):
            c = (scripts or {})[name.partition("=")[2]](c)
    if steps:
        c = text_function(chain(*steps))(c)
    c = columns.trim_blanks(unprotect(c, list(vocabulary), upper))
    return df.withColumn(column, c if keep_paragraphs else columns.single_blank_lines(c))


def final(text: str, lang: str = "en", upper: bool = False) -> str:
    """Numbers that are left in words, and single letters as capitals with a dot; for use after the options."""
    say, end = SPOKEN[lang].say, r"(?= |\n|\Z|'s? )"
    text = sub(r"(?:(?<= )|^)\d+(?:\.\d*)?(?= |\n|\Z)", lambda m: say(m[0]) or m[0], text)
    text = sub(rf"(?:(?<= )|^)([b-z]){end}", lambda m: m[1].upper() + ".", text)
    text = sub(rf"(?:(?<= )|^)([a-z]\.){end}", lambda m: m[1].upper(), text)
    text = sub(rf"(?:(?<=[ -])|^)([B-HJ-Z]){end}", r"\1.", text)
    return text.upper() if upper else text
