"""Rewrites that are the same for both languages, or nearly so."""

from __future__ import annotations

import re
import unicodedata

from textloom.functions.lexicon import Lexicon
from textloom.functions.patterns import AFTER, BEGIN, CAPITAL, CAPITAL_OR_DIGIT, END, LETTER, LO, TAGS, UP, compiled, fixpoint, sub, trim_blanks

_GERMAN = {"ä": "ae", "ñ": "ny", "ö": "oe", "ü": "ue", "ÿ": "yu"}
_LIGATURES = {"ß": "ss", "Æ": "AE", "æ": "ae", "Ĳ": "IJ", "ĳ": "ij", "Œ": "Oe", "œ": "oe", "ə": "e", "Ə": "e", "’": "'"}
#: Letters with strokes and the like, which decomposition leaves alone.
LETTERS = dict(zip("ÐĐðđĦħıĸĿŁŀł", "DDddHhikLLll")) | dict(zip("ŊŉŋØøſÞŦþŧ", "NnnOosTTtt"))
_FOLD = str.maketrans(_LIGATURES | LETTERS)
_UMLAUTS = str.maketrans(_GERMAN)
_LATIN = str.maketrans(_GERMAN | _LIGATURES | LETTERS | {"…": "..."})
_GREEK = str.maketrans(dict(α="alpha", β="beta", γ="gamma", δ="delta", Δ="delta", μ="micro", ρ="rho", λ="lambda", Λ="lambda"))


def strip_diacritics(text: str) -> str:
    """English: umlauts spelled out, other marks dropped, letters folded to ASCII."""
    if text.isascii():
        return text
    return strip_marks(text.translate(_UMLAUTS)).translate(_FOLD)


def fold_letters(text: str) -> str:
    """French: foreign letters folded; accents stay, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_FOLD))


def fold_greek(text: str) -> str:
    return text if text.isascii() else text.translate(_GREEK)


def fold_latin(text: str) -> str:
    return text if text.isascii() else text.translate(_LATIN)


def triple_letters(text: str) -> str:
    """Three or more equal small letters in a word become two."""
    text = sub(rf"(?<=\w)([{LO}])\1\1+", r"\1\1", text)
    return sub(rf"([{LO}])\1\1+(?=\w)", r"\1\1", text)


def space_punctuation(text: str) -> str:
    """Blanks around weak marks and quotes; a lone dash between words breaks the line."""
    text = sub(r"([,;:¡¿()]) ", r" \1 ", text)
    text = sub(r"([a-z]) - (?=[A-Za-z])", "\\1\n", text)
    text = text.replace(" (", " ( ")
    text = sub(r"\b([«»\"])", r" \1 ", text)
    text = sub(r"([«»\"])(?=\n|\b)", r" \1 ", text)
    return trim_blanks(text)


def clean_pdf(text: str) -> str:
    """Section numbers, list letters, page numbers and bullets at line starts, twice."""
    gap = r"(?:[ \n]|\Z)"
    for _ in range(2):
        text = sub(rf"^(?:\d\.)+{gap}", "", text)
        text = sub(rf"^\w\.{gap}", "", text)
        text = sub(rf"^\(?[i\d]+\)?{gap}", "", text)
        text = sub(r"^ +o +", "", text)
    return text


def clean_wide(text: str) -> str:
    """Question marks left by unreadable characters."""
    text = sub(r"\?(?! [0-9A-Z])", " ", text)
    text = sub(r"(?<=[-,;.?!])\?", " ", text)
    return trim_blanks(text)


def compact_acronyms(text: str) -> str:
    """``I. B. M.`` -> ``I.B.M.``"""
    return sub(r"(?:(?<= )|^)(?:[A-Z]\. ?)+[A-Z]\.[Ss]?(?='[sS]?|[ \n]|\Z)", lambda m: m[0].replace(" ", ""), text)


def telephone(text: str, pairs: bool = False) -> str:
    """Telephone numbers as spaced digits; repeats doubled (or digits in pairs)."""

    def say(m: re.Match) -> str:
        w = m[0]
        if compiled(r"(?:18|19|20)\d\d-(?:18|19|20)\d\d").fullmatch(w) or ("-" in w and "." in w):
            return w
        if compiled(r"\d{1,3}[-.]\d{1,3}|[0-3]\d[-.][0-3]\d[-.]\d{2,4}").fullmatch(w):
            return w
        plus = "plus " if "+" in w else ""
        digits = re.sub(r"\D", "", w)
        if pairs:
            body = " ".join(re.findall(r"\d\d?", digits))
        else:
            body = " ".join(digits)
            body = sub(r"\b(\d) \1 \1\b", r"triple \1", body)
            body = sub(r"\b(\d) \1\b", r"double \1", body)
        return f" <PHONE> {plus}{body} </PHONE> "

    lead = r"(?:(?<=\w )|^)"
    for shape in (
        r"\+? ?\d\d(?:[-. ]\d\d){3,4}(?= |$)",
        rf"\+? ?\d{{1,4}}(?:-\d{{3,5}}){{1,3}}{END}",
        rf"\+? ?\d{{1,4}}(?:-\d{{2,5}}){{2,4}}{END}",
        rf"\( ?\d{{1,4}} ?\) /? ?\d{{1,4}}(?:-\d{{2,5}}){{1,3}}{END}",
    ):
        text = sub(lead + shape, say, text)
    return trim_blanks(text)


def split_entities(text: str, places) -> str:
    """``Paris-London`` -> ``Paris London`` where both are listed."""
    any_place = "|".join(re.escape(p) for p in sorted(set(places), key=lambda p: (-len(p), p)))
    return sub(rf"(?:(?<= )|^)({any_place}) ?- ?({any_place}){END}", r"\1 \2", text) if any_place else text


def entity_fixes(text: str) -> str:
    """Roman numerals and ``Saint`` move into the tag they belong to."""
    text = sub(rf" (</[A-Z]+>) +((?:X[VI]?)+V*(?:I[VX]?)*){END}", r" \2 \1 ", text)
    text = sub(r"(?:(?<= )|^)Saint +<PERSON> +(?=[A-Z])", "<PERSON> Saint ", text)
    return trim_blanks(text)


def drop_bad_tags(text: str) -> str:
    """Malformed tags, and tags of unknown kinds."""
    text = sub(r"[<>]{2,}", " ", text)
    known = "|".join(TAGS)
    text = sub(rf"(?:(?<= )|^)<(?!/?(?:{known})>)[^>\s]*>{END}", " ", text)
    return sub(rf"(?:(?<= )|^)<[^>\s]+{END}", "", text) if "<" in text else text


def first_word_case(word: str, following: str, lexicon: Lexicon) -> bool:
    """Is the first word of a phrase to be written small?"""
    root = compiled(r"^(.*?)-[a-z].*$").sub(r"\1", word) if "-" in word else word
    if "'" in root:
        root = compiled(r"^(.*s)'$").sub(r"\1", root)
        root = compiled(r"^(.*)'s$").sub(r"\1", root)
    root = compiled(r"^(.*)\.").sub(r"\1", root) if "." in root else root
    small = root.lower()
    if compiled(r"[B-Z]|[A-Z]\.").fullmatch(root):
        return False
    if lexicon.tags(small) & {"DET", "PRO", "P", "CJ"}:
        return True
    tags = lexicon.tags(root)
    named = bool(tags & {"NP", "SYM"})
    if small in lexicon and named and not tags & {"N", "ADJ"}:
        return bool(following) and following[0].islower()
    if named or root in lexicon.proper:
        return False
    if compiled(rf"[-{UP}]{{2}}|\d").search(root):
        return False
    return small in lexicon


_PHRASE = re.compile(r"( (?:\.\.\.|[.?!:«»\"]) )")


def first_letters(text: str, lexicon: Lexicon, elision: bool = False) -> str:
    """Each phrase's first word in small letters, unless it looks like a name."""

    def phrase(part: str) -> str:
        words = re.split(r"\s", part)
        for k, w in enumerate(words):
            if w and w[0].isalpha():
                head, tail = w, ""
                if elision:
                    m = re.match(r"(.+')(.+)$", w)
                    if m:
                        head, tail = m[1], m[2]
                following = tail or (words[k + 1] if k + 1 < len(words) else "")
                if first_word_case(head, following, lexicon):
                    words[k] = head.lower() + tail
                break
        return " ".join(words)

    return "\n".join("".join(phrase(p) for p in _PHRASE.split(line)) for line in text.split("\n"))


def initials(text: str, lexicon: Lexicon) -> str:
    """``H . Smith`` -> ``H. Smith`` for names; sequences of initials are glued."""
    lone = compiled(rf"[{UP}] \. ").search(text)
    if lone:
        text = sub(rf"(^|[\s-])([{UP}]) \. (?=[-.,:;!?])", r"\1\2. ", text)
        text = sub(rf"(^|[\s-])([{UP}]) \. ([{UP}][{LO}]+)(?= [.,:;!?-]|$)", r"\1\2. \3", text)

    def decide(m: re.Match) -> str:
        return m[0] if first_word_case(m[3], "", lexicon) else f"{m[1]}{m[2]}. {m[3]} "

    if lone:
        text = sub(rf"(^|[\s-])([{UP}]) \. ([{UP}][{LO}]+) (?![.:;!?-])", decide, text)

    def glue(m: re.Match) -> str:
        run = sub(rf"([{UP}]) (?=\.)", r"\1", m[0])
        return sub(rf"([{UP}]\.?) (?=-[{UP}])", r"\1", run)

    text = sub(rf"(?:(?<=[ -])|^)(?:-?[{UP}] ?\.(?: |$)){{2,}}", glue, text)
    text = sub(rf"([{UP}])\. -(?=[{UP}]\.(?: |$))", r"\1.-", text)
    text = sub(rf"([{LO}]) -(?=[{UP}]\.(?: |$))", r"\1 ", text)
    return sub(rf"([{LO}])([,;!?])", r"\1 \2", text)


_CONSONANTS = "bcdfghjklmnpqrstvwxz"
_CAPITALS, _MANY_DOTS = re.compile("([A-Z])"), re.compile(r"(?:[A-Z]\.){6,}")


def acronyms(text: str, lexicon: Lexicon, chemicals: bool = False) -> str:
    """Acronyms with a dot after each letter: ``AFD`` -> ``A.F.D.``, ``FA-18`` -> ``F.A.-18``."""

    def dotted(m: re.Match) -> str:
        return sub(r"([A-Z])$", r"\1.", sub(r"[-.] ?", ".", m[0]))

    def explode(m: re.Match) -> str:
        if not re.search(r"[A-Z]", m[0]):
            return m[0]
        out = []
        for piece in m[0].split("-"):
            if len(piece) > 3 and piece.isalpha() and piece.lower() in lexicon:
                out.append(piece[0] + piece[1:].lower())
                continue
            piece = _CAPITALS.sub(r"\1.", piece)
            out.append(_MANY_DOTS.sub(lambda x: x[0].replace(".", ""), piece))
        return "-".join(out)

    def partial(word: str) -> str:
        if len(word) >= 3 and (word.lower() in lexicon or word.capitalize() in lexicon):
            return word
        m = re.match(f"({CAPITAL})({CAPITAL}+{LETTER}.*)$", word)
        return f"{m[1]}.{partial(m[2])}" if m else word

    plural_end = rf"(?:{END}|(?=s ))"
    text = sub(r"(?:(?<= )|^)\.(?=[a-z])", "", text)
    text = sub(rf"(?:(?<= )|^)(?:[a-z]\d)+{plural_end}", lambda m: m[0].upper(), text)
    text = sub(rf"\b({LETTER})(?={CAPITAL_OR_DIGIT})", lambda m: m[1].upper() + ".", text)
    text = sub(rf"\b[A-Z]{{2,}}(?:-[A-Z]{{2,}})+{plural_end}", lambda m: m[0].replace("-", " "), text)
    text = sub(rf"\b{CAPITAL_OR_DIGIT}(?:\. ?{CAPITAL_OR_DIGIT}){{2,}}\.?{plural_end}", dotted, text)
    text = sub(rf"\b{CAPITAL_OR_DIGIT}(?:-{CAPITAL_OR_DIGIT}){{2,}}{plural_end}", dotted, text)
    noises = compiled(r"hm+|br{2,}|gr{2,}|sh{2,}")
    text = sub(rf"(?:(?<=[ -])|^)[{_CONSONANTS}]{{2,}}{plural_end}", lambda m: m[0] if noises.fullmatch(m[0]) else m[0].upper(), text)
    # not after a dot or within a word, with an ampersand first at the start of a token only
    text = sub(rf"[A-Z0-9&](?<![.\w][\s\S])(?<![^ \n]&)[A-Z0-9&](?:[-&]?[A-Z0-9])*(?:{END}|(?=-|s'?(?: |\n|\Z)))", explode, text)
    text = sub(rf"(?:(?<=[ -])|^)({LETTER})&({LETTER}){plural_end}", lambda m: f"{m[1].upper()}.&{m[2].upper()}.", text)
    if chemicals:
        text = formulas(text)
    text = sub(rf"(?:(?<=[ -])|^)[A-Z]{{2,}}[a-z]+(?:{END}|(?=-))", lambda m: partial(m[0]), text)
    text = sub(r"(?:(?<= )|^)([A-Z])-", r"\1.-", text)
    text = sub(rf"(?:(?<= )|^)([B-HJ-Z]){END}", r"\1.", text)
    text = sub(rf"(?:(?<= )|^)([B-HJ-Z])'S{AFTER}", r"\1.'s", text)
    text = sub(r"(?:(?<= )|^)([AI])'[sS]", r"\1.'s", text)
    text = sub(rf"([A-Z]\.[A-Z]){END}", r"\1.", text)
    text = sub(rf"(?:(?<= )|^)({LETTER}+) ({CAPITAL}\.)'s{END}", r"\1 \2s", text)
    text = sub(rf"(?:(?<= )|^)([B-DF-HJ-NP-TVZ])s{END}", r"\1.s", text)
    text = sub(r"([A-Z0-9])\. '", r"\1.'", text)
    return trim_blanks(text)


_ELEMENTS = "Ag Al Br C Ca Cd Cl Co Cu Fe H He Hg K Li Mg N Na Ni Pb Pt Pu Ra S Si Ti U W Xe O".split()


def formulas(text: str) -> str:
    """``NaCl3`` -> ``Na.Cl.3`` where no element occurs twice."""
    element = "|".join(sorted(_ELEMENTS, key=lambda e: (-len(e), e)))

    def explode(m: re.Match) -> str:
        found = re.findall(rf"({element})\d?", m[0])
        if len(m[0]) <= 3 or len(found) != len(set(found)):
            return m[0]
        return re.sub(rf"({element})(\d?)", r"\1.\2", m[0])

    return sub(rf"(?:(?<= )|^)(?:(?:{element})[1-9]?){{2,}}(?:{END}|(?=-))", explode, text)


def restore_accents(word: str, by_plain: dict[str, list[str]], words: frozenset[str]) -> str:
    """The lexicon's accented form of a small word with the fewest changes; on a draw the word."""
    if word in words or not compiled(rf"[-_{LO}]+").fullmatch(word):
        return word
    found = [(sum(a != b for a, b in zip(v, word)), v) for v in by_plain.get(strip_marks(word), []) if len(v) == len(word)]
    if not found:
        return word
    found.sort()
    return word if len(found) > 1 and found[0][0] == found[1][0] else found[0][1]


def strip_marks(text: str) -> str:
    text = unicodedata.normalize("NFD", text)
    for mark in {c for c in set(text) if unicodedata.category(c)[0] == "M"}:
        text = text.replace(mark, "")
    return text


def name_case(text: str) -> str:
    """Personal names: capitals after every boundary, Mc and Mac forms, small particles."""
    text = sub(r"\b\w", lambda m: m[0].upper(), text.lower())
    text = sub(r"'\w\b", lambda m: m[0].lower(), text)
    if compiled(r"\bM(?:ac[a-zA-Z]{2,}[^acijoz]\b|c)").search(text):
        text = sub(r"\b(Ma?c)([a-zA-Z]+)", lambda m: m[1] + m[2].capitalize(), text)
        text = sub(r"\bMac(Evicius|Hado|Hin|Hlin|Kle|Klin|Quarie)", lambda m: "Mac" + m[1].lower(), text)
    for particle in ("al", "ap", "dell", "de", "der", "di", "la", "lo", "van", "von"):
        text = sub(rf"(?<=\w )\b{particle.capitalize()}\b(?= \w)", particle, text)
    return sub(r"\b(?:Ii|Iii|Iv|Vi|Vii|Viii|Ix|Xi|Xii)\b", lambda m: m[0].upper(), text)


__all__ = ["BEGIN", "fixpoint"]
