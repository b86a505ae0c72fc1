"""Whole normalisation chains, each in one Arrow function over a text column."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import cleaning, english, french
from textloom.functions.arrow import chain, text_function
from textloom.functions.lexicon import ENGLISH, FRENCH, PLACES, Lexicon
from textloom.functions.patterns import compiled, sub, trim_blanks
from textloom.functions.tokens import tokenize
from textloom.operators import rules
from textloom.operators.specific import PRESETS, specific


@dataclasses.dataclass(frozen=True)
class Resources:
    """What a chain looks up; every part can be replaced by loaded data.

    ``tagger`` puts tags around named entities; by default it adds none.  The sets of
    ``names`` apply one after the other.
    """

    lexicon: Lexicon
    places: tuple[str, ...] = PLACES
    special: rules.RuleSet = rules.RuleSet([])
    hesitations: rules.RuleSet = rules.RuleSet([])
    spelling: rules.RuleSet = rules.RuleSet([])
    abbreviations: rules.RuleSet = rules.RuleSet([])
    names: tuple[rules.RuleSet, ...] = ()
    case: rules.RuleSet = rules.RuleSet([])
    hyphens: rules.RuleSet = rules.RuleSet([])
    apostrophes: rules.RuleSet = rules.RuleSet([])
    roman: rules.RuleSet = rules.RuleSet([])
    acronyms: rules.RuleSet = rules.RuleSet([])
    final: rules.RuleSet = rules.RuleSet([])
    tagger: Callable[[str], str] = str


RESOURCES = {
    "en": Resources(
        ENGLISH,
        hesitations=rules.built_in(rules.HESITATIONS),
        spelling=rules.built_in(rules.UK_TO_US),
        abbreviations=rules.built_in(rules.ABBREVIATION_RULES),
    ),
    "fr": Resources(FRENCH, abbreviations=rules.built_in(rules.ABBREVIATION_RULES_FR), case=rules.built_in(rules.ACCENTS_FR)),
}
Step = Callable[[str], str]


def start(lang: str, r: Resources) -> list[Step]:
    """Mending, spelling, expansion and tagging."""
    lex = r.lexicon
    if lang == "fr":
        return [
            french.remove_bugs,
            r.special.apply,
            cleaning.triple_letters,
            lambda t: cleaning.initials(t, lex),
            cleaning.space_punctuation,
            cleaning.fold_letters,
            r.hesitations.apply,
            r.case.apply,
            lambda t: cleaning.first_letters(t, lex, elision=True),
            r.spelling.apply,
            r.abbreviations.apply,
            french.complex_abbreviations,
            french.url,
            lambda t: t.replace("_", " "),
            french.date_and_time,
            french.currencies,
            french.units,
            lambda t: cleaning.telephone(t, pairs=True),
            *[s.apply for s in r.names],
            lambda t: cleaning.split_entities(t, r.places),
            trim_blanks,
        ]
    return [
        english.remove_bugs,
        english.process_ing,
        english.process_d,
        r.special.apply,
        cleaning.triple_letters,
        lambda t: cleaning.initials(t, lex),
        cleaning.space_punctuation,
        cleaning.strip_diacritics,
        r.hesitations.apply,
        lambda t: cleaning.first_letters(t, lex),
        r.spelling.apply,
        r.abbreviations.apply,
        english.complex_abbreviations,
        english.url,
        lambda t: t.replace("_", " "),
        english.date_and_time,
        english.currencies,
        english.units,
        cleaning.telephone,
        *[s.apply for s in r.names],
        lambda t: cleaning.split_entities(t, r.places),
        trim_blanks,
    ]


def finish(lang: str, r: Resources, keep_punctuation: bool = False) -> list[Step]:
    """Hyphens, apostrophes, acronyms, numbers and leftovers."""
    lex, step = r.lexicon, french if lang == "fr" else english
    weak: list[Step] = [english.drop_weak_punctuation] if lang == "en" and not keep_punctuation else []
    return [
        r.tagger,
        cleaning.entity_fixes,
        r.case.apply,
        r.hyphens.apply,
        lambda t: step.hyphenate(t, lex),
        lambda t: step.apostrophes(t, lex),
        r.apostrophes.apply,
        r.roman.apply,
        lambda t: step.roman_numbers(t, lex),
        lambda t: cleaning.acronyms(t, lex),
        r.acronyms.apply,
        trim_blanks,
        lambda t: step.numbers(t, lex),
        *weak,
        cleaning.fold_letters if lang == "fr" else cleaning.strip_diacritics,
        r.final.apply,
        step.end,
    ]


def speech(keep_paragraphs: bool, keep_punctuation: bool) -> list[Step]:
    """One sentence a line, no tags, for a speech synthesiser."""

    def run(text: str) -> str:
        text = sub(r"[()]", ",", text)
        text = sub(r"([,;:¡¿]) *,", r"\1", text)
        text = sub(r"(?:(?<= )|^)['-](?= |\n|\Z)", "", text)
        strong = r" (\.\.\.|[.?!])(?: |$)"
        if keep_punctuation:
            text = sub(strong, r" \1 " if keep_paragraphs else " \\1\n", text)
        else:
            text = sub(r"[,;:¡¿]", " ", text)
            text = sub(strong, " " if keep_paragraphs else "\n", text)
            text = sub(r"\.\.+|\?+|!+", " ", text)
            text = sub(r" \.+$", "", text)
        text = sub(r"^\.+", "", text)
        text = sub(r" </?[A-Z]+>|</?[A-Z]+> ?", "", text)
        text = trim_blanks(text)
        if not keep_paragraphs:
            text = sub(r"\n+", "\n", text.replace("\r", "")).strip("\n")
        return text + "\n"

    return [run]


def _supported(lang: str) -> Resources:
    if lang not in RESOURCES:
        raise ValueError(f"language {lang}; there are {sorted(RESOURCES)}")
    return RESOURCES[lang]


def _with(df: DataFrame, column: str, steps: list[Step]) -> DataFrame:
    return df.withColumn(column, text_function(chain(*steps))(F.col(column)))


def tokenised(df: DataFrame, column: str = "text", lang: str = "en") -> DataFrame:
    return _with(df, column, [lambda t: tokenize(t, lang)])


def generic(df: DataFrame, column: str = "text", lang: str = "en", resources: Resources | None = None, keep_punctuation: bool = False) -> DataFrame:
    """Tokenise, start and finish in one pass."""
    r = resources or _supported(lang)
    return _with(df, column, [lambda t: tokenize(t, lang), *start(lang, r), *finish(lang, r, keep_punctuation)])


def normalised(df: DataFrame, preset: str | list[str], column: str = "text", lang: str = "en", resources: Resources | None = None, keep_paragraphs: bool = False) -> DataFrame:
    """The whole chain with the options of a preset or a list."""
    options = PRESETS[preset] if isinstance(preset, str) else preset
    keep = "PUNCTUATION_ON" in options or "WEAK_PUNCTUATION_OFF" not in options and "BREAK_LINES" in options and "PUNCTUATION_OFF" not in options
    return specific(generic(df, column, lang, resources, keep), column, options, lang=lang, keep_paragraphs=keep_paragraphs)


def speech_text(df: DataFrame, column: str = "text", lang: str = "en", keep_paragraphs: bool = False, keep_punctuation: bool = True) -> DataFrame:
    """The one-shot chain for speech synthesis."""
    r = _supported(lang)
    return _with(df, column, [*start(lang, r), *finish(lang, r, True), *speech(keep_paragraphs, keep_punctuation)])


__all__ = ["Resources", "compiled", "generic", "normalised", "speech_text", "tokenised"]
