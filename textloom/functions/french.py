"""French normalisation steps, each from text to text."""

from __future__ import annotations

import re

from textloom.functions import english
from textloom.functions import numbers_fr as num
from textloom.functions import roman
from textloom.functions.cleaning import first_letters
from textloom.functions.lexicon import FRENCH_CURRENCIES, FRENCH_UNITS, Lexicon
from textloom.functions.numbers_en import plural
from textloom.functions.patterns import BEGIN, COLON, END, HALVES, HOUR, LO, MINUTE, MODERN, NAME, NUMBER, NUMERAL, ROMAN_MARK, UP, YEAR_MARK, compiled, fixpoint, sub, tag, trim_blanks

MONTHS = "janvier février mars avril mai juin".split() + "juillet août septembre octobre novembre décembre".split()
_SHORT = {"jan": 0, "janv": 0, "fév": 1, "févr": 1, "avr": 3, "juil": 6, "sept": 8, "sep": 8, "oct": 9, "nov": 10, "déc": 11}
_MONTH = "(?:" + "|".join(MONTHS) + "|(?:" + "|".join(sorted(_SHORT, key=len, reverse=True)) + r")\.)"
_DAY_NAME = "(?:" + "|".join(d + "di" for d in ("lun", "mar", "mercre", "jeu", "vendre", "same")) + "|dimanche)"
_DAY, _MONTH_NUMBER = english._DAY, english._MONTH_NUMBER
_SINCE = "après|avant|de|depuis|durant|en|jusqu'à|pendant|vers|à"
_DIGIT = "(?:" + "|".join(num.cardinal(str(n)) for n in range(1, 10)) + ")"
_SMALL = "(?:" + "|".join(sorted((num.cardinal(str(n)) for n in range(10, 100)), key=lambda w: -len(w))) + f"|{_DIGIT})"
_SPELLED = rf"(?:{_SMALL} (?:milliards?|millions?|mille) )*(?:(?:{_DIGIT} )?cents? )?{_SMALL}(?: (?:point|virgule) {_SMALL})?"


def remove_bugs(text: str) -> str:
    """As in English, with ``et`` for the ampersand and ``dièse`` before numbers."""
    text = text.replace(" & ", " et ")
    text = sub(r" #(\d+)(?= |$)", r" dièse \1", text)
    return english.remove_bugs(text)


def complex_abbreviations(text: str) -> str:
    """``XXIe`` -> ``21e``, ``XXI siècle`` -> ``21e siècle``, ``Rennes-I`` -> ``Rennes 1``."""
    ordinal = r"(?:i?[eè]me|[eè])"
    text = sub(rf"{BEGIN}([XVI]+)\.?{ordinal}{END}", lambda m: roman.decimal(m[1], True) + "e", text)
    text = sub(
        rf"{BEGIN}([IVX]+) ([Aa]rmée|[Rr]épublique|[Ss]iècle){END}", lambda m: f"{roman.decimal(m[1], True)}e {m[2]}", text
    )
    text = sub(rf"\b([{UP}][{LO}]+)-([IVXLCDM]+){END}", lambda m: f"{m[1]} {roman.decimal(m[2], True)}", text)
    text = sub(r"([A-Za-z0-9]) ?\+", r"\1 plus ", text)
    return trim_blanks(text)


_SIGNS = {".": "point", "/": "slash", ":": "deux points", "-": "tiret", "_": "souligné", "~": "tilde", "@": "arobase"}


def url(text: str) -> str:
    return english.url(text, _SIGNS)


def month_name(text: str) -> str:
    if text.isdigit():
        return MONTHS[int(text) - 1] if 1 <= int(text) <= 12 else text
    short = text.rstrip(".").lower()
    return MONTHS[_SHORT[short]] if short in _SHORT else text.lower()


def _era(mark: str | None) -> str:
    letters = (mark or "").replace(".", "").upper()
    return {"AD": " après Jésus-Christ", "BC": " avant Jésus-Christ"}.get(letters, "")


def date(month: str, day: str, year: str, era: str | None = None) -> str:
    """``vingt et un octobre deux mille cinq``, tagged."""
    said = num.year(english.full_year(year)) if not era else num.year(year)
    parts = [num.cardinal(str(int(day))) if day else "", month_name(month) if month else "", said]
    return tag("DATE", " ".join(p for p in parts if p) + _era(era))


def time(hour: str, minute: str = "", second: str = "", half: str = "") -> str:
    """``neuf heures moins vingt``, tagged."""
    h, m, s = int(hour), int(minute or 0), int(second or 0)
    part = half.replace(".", "").upper()[:1]
    if not m and not s and h in (12, 24):
        return tag("TIME", "minuit" if h == 24 or part == "A" else "midi")

    def hours(n: int) -> str:
        return ("une" if n == 1 else num.cardinal(str(n))) + f" heure{plural(n)}"

    name = hours(h)
    following = hours((h + 1) % 12)
    if s:
        said = f"{name} {num.cardinal(str(m))} et {num.cardinal(str(s))}"
    elif not m:
        said = name
    elif m in (15, 30):
        said = name + (" et quart" if m == 15 else " et demie")
    elif m == 45:
        said = following + " moins le quart"
    else:
        said = f"{following} moins {num.cardinal(str(60 - m))}" if m > 30 else f"{name} {num.cardinal(str(m))}"
    if part == "P":
        said += " du soir" if h > 6 else " de l'après-midi"
    elif part == "A":
        said += " du matin"
    return tag("TIME", said)


_MARKS = (
    r"(?:jours?|j \.|j\.?)",
    r"(?:heures?|h \.|h\.?)",
    r"(?:minutes?|min ?\.?|mn ?\.?|')",
    r"(?:secondes?|sec ?\.?|s \.|s\.?|'')",
    r"(?:millisecondes?|ms ?\.?)",
)


def date_and_time(text: str) -> str:
    """Dates, years, clock times and durations in words, tagged."""
    i = re.I
    text = sub(
        rf"{BEGIN}({_DAY_NAME}),? *((?:le )?) *({_DAY}),? *({_MONTH})(?: ?, ?| )?(\d{{4}})?{END}",
        lambda m: tag("DATE", f"{m[1]} {m[2]}{num.cardinal(m[3])} {month_name(m[4])} {num.year(m[5]) if m[5] else ''}"),
        text,
        i,
    )
    text = sub(rf"{BEGIN}({_DAY}|1er) ({_MONTH}) (\d{{3,4}}){END}", lambda m: date(m[2], "1" if m[1] == "1er" else m[1], m[3]), text, i)
    text = sub(rf"{BEGIN}({_MONTH}) (?:, )?(19\d\d|20\d\d){END}", lambda m: date(m[1], "", m[2]), text, i)
    text = sub(rf"{BEGIN}({_SINCE}) ({_MONTH}) (?:, )?(\d{{3,4}}){END}", lambda m: f"{m[1]} {date(m[2], '', m[3])}", text, i)
    text = sub(rf"{BEGIN}({_SINCE}) +([12][0-7]\d\d|20\d\d){END}", lambda m: f"{m[1]} {tag('DATE', num.year(m[2]))}", text, i)
    text = sub(rf"{BEGIN}(après|avant|de|depuis|jusqu'à|vers|à) (minuit|midi){END}", lambda m: f"{m[1]} {tag('TIME', m[2])}", text, i)
    text = sub(rf"{BEGIN}({_MONTH_NUMBER})( ?[-./] ?)({_DAY})\2([12]?\d?\d\d){END}", lambda m: date(m[1], m[3], m[4]), text)
    text = sub(rf"{BEGIN}({_DAY})( ?[-./] ?)({_MONTH_NUMBER})\2([12]?\d?\d\d){END}", lambda m: date(m[3], m[1], m[4]), text)
    text = sub(rf"{BEGIN}({_DAY}) +({_MONTH_NUMBER}) +(20\d\d|1[6-9]\d\d){END}", lambda m: date(m[2], m[1], m[3]), text)
    text = sub(
        rf"{BEGIN}(\d{{3,4}}) ?- ?(\d{{3,4}}){END}",
        lambda m: f"{tag('DATE', num.year(m[1])).strip()} - {tag('DATE', num.year(m[2])).strip()}",
        text,
    )
    text = sub(rf"{BEGIN}([1-9]\d{{1,3}}) ?({english.ERA})(?=\W|\Z)", lambda m: date("", "", m[1], m[2]), text)
    text = sub(rf"(?:(?<=[ \n-])|(?<![\s\S]))({MODERN})(?:{END}|(?=-))", rf" {YEAR_MARK} \1 ", text)
    text = text.replace("</DATE> - <DATE>", "</DATE> à <DATE>")
    half = r"([AP])\.?M\.?"
    text = sub(
        rf"{BEGIN}({HOUR}){COLON}({MINUTE})(?:{COLON}({MINUTE}))?\s?{half}{END}",
        lambda m: time(m[1], m[2], m[3] or "", m[4]),
        text,
        i,
    )
    text = sub(rf"{BEGIN}({HOUR})([0-5]\d)? ?{half}{END}", lambda m: time(m[1], m[2] or "", "", m[3]), text, i)
    text = sub(rf"{BEGIN}([01]\d|2[0-4]){COLON}([0-5][05]){END}", lambda m: time(m[1], m[2]), text)
    text = english.durations(text, ("jour", "heure", "minute", "seconde", "milliseconde"), _MARKS)
    text = sub(rf"{BEGIN}({HOUR}) *[hH] *([0-5]\d)?{END}", lambda m: time(m[1], m[2] or ""), text)
    return trim_blanks(text)


_MANY = {"b": "milliard ", "m": "million ", "M": "million ", "": ""}


def currencies(text: str) -> str:
    return english.currencies(text, FRENCH_CURRENCIES, _SPELLED, _MANY)


_POWER = {"2": "carrés", "²": "carrés", "3": "cubes", "³": "cubes"}


def units(text: str) -> str:
    text = english.units(text, FRENCH_UNITS, _SPELLED, "par", "degré", _POWER, True, "eè")
    return text


def roman_numbers(text: str, lexicon: Lexicon) -> str:
    """Marked numerals as numbers, after names as ``Ne``, long ones and lone lines always."""
    text = sub(rf"{ROMAN_MARK} ([IVXLCDM]+)", lambda m: f" {roman.decimal(m[1])} ", text)

    def nth(m: re.Match) -> str:
        value = roman.to_int(m[2])
        return m[0] if value is None else f"{m[1]} {value}e"

    text = sub(rf"\b({NAME}) ({NUMERAL}+)(?= |$)", nth, text)
    text = sub(r"^([IVXLCDM]+)(?=\.| |$)", lambda m: roman.decimal(m[1]), text)
    text = sub(r"(?<!<ORGANIZATION> )(?<= )([IVXLCDM]{3,})(?=\.| |$)", lambda m: roman.decimal(m[1]), text)
    return trim_blanks(text)


_CLITICS = sorted({"ce", "elle", "elles", "il", "ils", "je", "la", "le", "les", "leur", "lui", "moi", "nous", "on", "toi", "tu", "vous", "en", "y", "ci", "là", "même", "mêmes"}, key=lambda w: (-len(w), w))
_WITH_T = r"-t-(?:elles?|ils?|on|en)"
_CLITIC = rf"(?:{_WITH_T}|-(?:{'|'.join(_CLITICS)}))"
_WHOLE = compiled(r"[Cc]hez-(?:[mt]oi|nous)|[Ee]ntre-lui|[Rr]endez-vous")


def hyphenate(text: str, lexicon: Lexicon) -> str:
    """Clitics stand apart with their hyphen; names and listed words keep theirs."""
    keep = ""

    def clitic(m: re.Match) -> str:
        return m[0] if _WHOLE.fullmatch(m[0]) else f"{m[1]} {m[2]}"

    text = sub(rf"{BEGIN}([^ \n]+?)({_CLITIC})(?= |\n|\Z)", clitic, text)
    text = sub(rf"(?<= )-(?!(?:t-)?(?:{'|'.join(_CLITICS)})(?= |\n|\Z))([^ \d\n]+)(?= |\n|\Z)", r"\1", text)
    text = sub(r"--+", " - ", text)
    text = sub(r" +- +", " ", text)
    text = sub(r"(?<=\d)-(?=\d)", " ", text)

    def cut(m: re.Match) -> str:
        w = m[0]
        if compiled(rf"[{UP}]\.?.*-[A-Z0-9]").match(w) or w in lexicon or _WHOLE.fullmatch(w):
            return w.replace("-", keep)
        both = compiled(HALVES + ")").fullmatch(w)
        if both and (both[2] + both[3]).lower() in lexicon:
            return both[1] + both[2] + both[3]
        return w.replace("-", " -")

    text = sub(rf"{BEGIN}[^ \n-]+(?:-[^ \n-]+)+(?= |\n|\Z)", cut, text)
    text = sub(r" -t-(ils|elles)(?= )", r" -\1", text)
    text = sub(r"^-+(?=[^0-9])", "", text)
    text = sub(rf" -(?=[{UP}][^ .-])", " ", text)
    return trim_blanks(text.replace(keep, "-"))


_ELIDED = r"(?:[CDJLMNSTcdjlmnst]|(?:[Jj]us|[Ll]ors|[Pp](?:res|uis)|[Qq]u(?:el|oi))?(?:(?<=[\w])q|(?<![\w])[Qq])u)"


def apostrophes(text: str, lexicon: Lexicon) -> str:
    """Elided words stand apart: ``l'image`` -> ``l' image``."""
    text = sub(r" +'", "'", text)
    text = sub(rf"{BEGIN}({_ELIDED})'(?=[AEIOUYHaeiouyhÀ-ÖØ-öø-ÿ])", r"\1' ", text)

    def cut(m: re.Match) -> str:
        w = m[0]
        if w[0].isupper() or w in lexicon or w.startswith("'"):
            return w
        return w.replace("'", "' ")

    text = sub(rf"{BEGIN}[^\s']+(?:'[^\s']+)+(?= |\n|\Z)", cut, text)
    return trim_blanks(sub(r" (\d+)' ", r" \1 ", text))


def numbers(text: str, lexicon: Lexicon) -> str:
    """All remaining digits in words."""
    say, nth = num.cardinal, num.ordinal
    i = re.I
    text = sub(rf"{YEAR_MARK} ({MODERN})(?:{END}|(?=-))", lambda m: tag("DATE", num.year(m[1])), text)
    text = sub(rf"\b({_SINCE}) (20\d\d|1[3-9]\d\d){END}", lambda m: f"{m[1]} {tag('DATE', num.year(m[2]))}", text, i)
    text = sub(r"(?<=\d),(?=\d{3}(?: |$))", "", text)
    text = sub(r"(?:(?<= )|^)-(?=\d)", "moins ", text)
    text = sub(r"\+ ?(?=\d)", " plus ", text)
    text = fixpoint(rf"{BEGIN}({NUMBER}) *[xX] *(?={NUMBER}(?:/| |\n|\Z))", r"\1 par ", text)
    text = text.replace(" × ", " fois ")
    for sign, word in ((" <= ", "est inférieur ou égal à"), (" >= ", "est supérieur ou égal à"), (" < ", "est inférieur à"), (" <", "inférieur à"), (" > ", "est supérieur à"), (" >", "supérieur à")):
        text = sub(rf"{sign}(?=\d)", f" {word} ", text)
    text = sub(r" *=+ *", " égale ", text)
    text = sub(r"(?<![\d/])1/2(?![\d/])", "un demi", text)
    text = sub(r"(?<![\d/])([12])/3(?![\d/])", lambda m: f"{say(m[1])} tiers", text)
    text = sub(r"(?<![\d/])1/4(?![\d/])", "un quart", text)
    text = sub(r"(?<![\d/])3/4(?![\d/])", "trois quarts", text)
    text = sub(r"\b1 ?er(s?)\b", r"premier\1", text)
    text = sub(r"\b1 ?(?:ère|ere|re)(s?)\b", r"première\1", text)
    text = sub(r"\b2 ?n?d(s?)\b", r"second\1", text)
    text = sub(r"\b2 ?n?de(s?)\b", r"seconde\1", text)
    text = sub(r"\b(\d+) ?-?i?[èe](?:me)?(s?)\b", lambda m: (nth(m[1]) or m[1]) + m[2], text)
    text = sub(r"\b(\d+) */ *([1-9]\d)\b(?![.,]\d)", lambda m: f"{say(m[1])} {nth(m[2])}{plural(m[1])}", text)
    decimal = r"\d+(?:[.,]\d+)*"
    text = sub(rf"\b({decimal}) */ *({decimal})\b", lambda m: f"{say(m[1]) or m[1]} sur {say(m[2]) or m[2]}", text)
    text = sub(rf"{BEGIN}(?:\d+\.){{2,}}(?=\d| |\n|\Z)", lambda m: m[0].replace(".", " "), text)
    text = sub(rf"{BEGIN}({decimal})(?=[- \n]|\Z)", lambda m: say(m[1]) or m[1], text)
    text = sub(rf"{BEGIN}({decimal})\.([A-Za-z]+) ", lambda m: f"{say(m[1]) or m[1]} . {first_letters(m[2], lexicon)} ", text)
    return trim_blanks(text)


def end(text: str) -> str:
    """As in English, but elided words (``l'``, ``d'``, ``qu'``) stay."""
    return english.end(text, num.cardinal, "et", "plus", "slash", "point", elision=True)
