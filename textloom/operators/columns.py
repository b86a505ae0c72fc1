"""Rewrites as column expressions, evaluated in the JVM within code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

END = r"(?= |\n|$|'[sS]? )"
WEAK = r"[,;:\"()¡¿]"
STRONG = r"(?:\.\.\.|[?!_.])"
ANY_MARK = r"(?:\.\.\.|[¡¿,;:\"()?!_.])"


def rr(c: Column, *pairs: tuple[str, str]) -> Column:
    """Replacements in order."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def trim_blanks(c: Column) -> Column:
    return rr(c, (" +", " "), ("(?dm) $", ""), ("(?dm)^ ", ""))


def single_blank_lines(c: Column) -> Column:
    """Of a run of blank lines one, and none more than one line feed at either end."""
    return rr(c, (r"\A\n{2,}|\n{2,}\z", "\n"), ("\n{3,}", "\n\n"))


def _drop(c: Column, marks: str) -> Column:
    return trim_blanks(rr(c, (rf" {marks}(?= )", " "), (rf"(?dm)^{marks}(?= )", ""), (rf"(?dm) {marks}$", "")))


def punctuation_off(c: Column) -> Column:
    return _drop(c, ANY_MARK)


def weak_punctuation_off(c: Column) -> Column:
    return _drop(c, WEAK)


def break_lines(c: Column) -> Column:
    """A line feed after each strong mark; runs of marks stay together."""
    return trim_blanks(rr(c, (rf"(?<= )({STRONG}) ", "$1\n"), ("(?dm)^ +", ""), (rf"({STRONG})\n(?={STRONG})", "$1 ")))


def sentences(c: Column) -> Column:
    """The lines of ``break_lines`` as an array."""
    return F.split(break_lines(c), "\n")


def hyphens_off(c: Column) -> Column:
    return F.translate(c, "-", " ")


def hyphens_internal(c: Column) -> Column:
    return rr(c, ("(?dm)(^| )-", "$1"), ("(?dm)-( |\n|$)", "$1"))


def saxon_exploded(c: Column, upper: bool = False) -> Column:
    s = "'S" if upper else "'s"
    return rr(c, ("(?dmi)'s( |\n|$)", f" {s}$1"), ("(?dmi)(s)'( |\n|$)", f"$1 {s}$2"))


def saxon_joint(c: Column) -> Column:
    return F.replace(c, F.lit(" 's"), F.lit("'s"))


def tags_off(c: Column) -> Column:
    return saxon_joint(trim_blanks(rr(c, (" ?</?[A-Z]+> ?", " "))))


def tag_off(c: Column, name: str) -> Column:
    return saxon_joint(trim_blanks(rr(c, (rf" ?</?{name}> ?", " "))))


def tags_on(c: Column) -> Column:
    """Each tagged body gives way to its opening tag."""
    return rr(c, ("<([A-Z]+)> .*? </\\1>", "<$1>"))


def tag_bodies(c: Column) -> Column:
    """Array of (tag, body) of all tagged spans, in order."""
    found = F.regexp_extract_all(c, F.lit(r"<([A-Z]+)> .*? </\1>"), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, "^<([A-Z]+)>", 1).alias("tag"), F.regexp_extract(x, "^<[A-Z]+> (.*) </[A-Z]+>$", 1).alias("body")
        ),
    )


def letter_dots_off(c: Column) -> Column:
    return rr(c, (r"(?dm)(^| )([^. \n])\.(?= |$)", "$1$2"))


def acronyms_joint(c: Column) -> Column:
    """``P.C.A.`` -> ``PCA``"""
    return rr(c, (r"(?<=[A-Z])\.(?=-?[A-Z])", ""), (r"(?<=[A-Z]{2})\.(?![A-Z])", ""))


def case_off(c: Column) -> Column:
    return F.upper(c)


def case_low(c: Column) -> Column:
    return F.lower(c)


def thousand_separators(c: Column) -> Column:
    return rr(c, (r"(?<=\d),(?=\d{3}(?!\d))", ""))


_GERMAN = (("ä", "ae"), ("ñ", "ny"), ("ö", "oe"), ("ü", "ue"), ("ÿ", "yu"))
_LIGATURES = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "Oe"), ("œ", "oe"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("…", "..."))
_FROM, _TO = "ÐĐðđĦħıĸĿŁŀł" + "ŊŉŋØøſÞŦþŧ" + "əƏ’", "DDddHhikLLll" + "NnnOosTTtt" + "ee'"


def latin_fold(c: Column) -> Column:
    """Letters of other alphabets spelled in ASCII where one or two letters do."""
    for old, new in _GERMAN + _LIGATURES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.translate(c, _FROM, _TO)


def greek_names(c: Column) -> Column:
    for old, new in dict(α="alpha", β="beta", γ="gamma", δ="delta", Δ="delta", μ="micro", ρ="rho", λ="lambda", Λ="lambda").items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def triple_letters(c: Column) -> Column:
    small = "a-zß-öø-ÿ"
    return rr(c, (rf"(?U)(?<=\w)([{small}])\1\1+", "$1$1"), (rf"(?U)([{small}])\1\1+(?=\w)", "$1$1"))


def clean_pdf(c: Column) -> Column:
    gap = "(?:[ \n]|$)"
    once = ((rf"(?dm)^(?:\d\.)+{gap}", ""), (rf"(?dm)^\w\.{gap}", ""), (rf"(?dm)^\(?[i\d]+\)?{gap}", ""), ("(?dm)^ +o +", ""))
    return rr(c, *once, *once)


def clean_wide(c: Column) -> Column:
    return trim_blanks(rr(c, (r"\?(?! [0-9A-Z])", " "), (r"(?<=[,;\-.?!])\?", " ")))


def space_punctuation(c: Column) -> Column:
    return trim_blanks(
        rr(
            c,
            (r"([,;:¡¿()]) ", " $1 "),
            ("([a-z]) - (?=[A-Za-z])", "$1\n"),
            (r" \(", " ( "),
            (r"\b([«»\"])", " $1 "),
            (r"([«»\"])(?=\n|\b)", " $1 "),
        )
    )


#: Consonants that may begin and end a syllable.
ONSETS = ("S?CH", "S[HLMN]", "SK[RW]?", "SP[LR]?", "D[RW]", "T[RW]", "[CKG][LRW]", "[BFP][LR]", "SW", "[B-DF-HJ-NP-TV-XZ]")
CODAS = ("LCH", "L[BDJKMPT]", "[CFKP]T", "PS", "S[KPT]", "M[FP]", "N[DT]", "[B-DF-HJ-NP-TV-XZ]")


def pronounceable(c: Column) -> Column:
    """Can an acronym of three to six letters be read as a word?"""
    w = F.replace(c, F.lit("."), F.lit(""))
    vowel = "[AEIOUY]"
    onset, coda = f"(?:{'|'.join(ONSETS)})", f"(?:{'|'.join(CODAS)})"
    return F.coalesce(F.length(w).between(3, 6) & w.rlike(vowel) & w.rlike(f"^(?:{onset}?{vowel}{vowel}?)+{coda}?$"), F.lit(False))
