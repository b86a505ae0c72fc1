"""English normalisation steps, each from text to text.

Wordings that could vary are fixed: dates read ``the D of Month Year``, times
``quarter past``; a document always comes out the same.
"""

from __future__ import annotations

import calendar
import re

from textloom.functions import numbers_en as num
from textloom.functions import roman
from textloom.functions.cleaning import first_letters
from textloom.functions.lexicon import ENGLISH_CURRENCIES, ENGLISH_UNITS, Lexicon, Unit
from textloom.functions.patterns import (
    AFTER,
    BEGIN,
    CAPITAL,
    CAPITAL_OR_DIGIT,
    COLON,
    END,
    HALVES,
    HOUR,
    LETTER,
    LO,
    MINUTE,
    MODERN,
    NAME,
    NUMBER,
    NUMERAL,
    ROMAN_MARK,
    UP,
    YEAR_MARK,
    alternation,
    characters,
    compiled,
    fixpoint,
    holds,
    sub,
    tag,
    trim_blanks,
)

ERA = "(?:A[.]?D|B[.]?C)[.]?"
CLOSED = f"</{CAPITAL}+>"
MONTHS = list(calendar.month_name)[1:]
_SHORT = {m[:3]: m for m in MONTHS if m != "May"} | {"Sept": "September"}
_MONTH = "(?:" + "|".join(MONTHS) + "|(?:" + "|".join(_SHORT) + r")\.)"
_DAY_NAME = "(?:" + "|".join(calendar.day_name) + ")"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTH_NUMBER = r"(?:0?[1-9]|1[0-2])"
_WHEN = "after|at|before|from|since|to|until"
_SINCE = "in|on|since|before|after|until|from|to"
_DIGIT = "(?:" + "|".join(num.cardinal(str(n)) for n in range(1, 10)) + ")"
_SMALL = "(?:" + "|".join(num.cardinal(str(n)) for n in sorted(range(10, 100), key=lambda n: -len(num.cardinal(str(n))))) + f"|{_DIGIT})"
_SPELLED = rf"(?:{_SMALL} (?:billion|million|thousand) )*(?:{_DIGIT} hundred(?: and)? )?{_SMALL}(?: point {_SMALL})?"


def remove_bugs(text: str) -> str:
    """Slips common to all sources: signs, spacing, small roman numerals, ``Co`` and the like."""
    text = sub(r" ß-", " beta-", text)
    text = sub(r"(?<=\w)ß(?=\w)", "ss", text)
    text = sub(rf"\b(?:x[liv]?|lx)+v*(?:i[vx]?)*{END}", lambda m: m[0].upper(), text)
    text = text.replace("€", " EUR ").replace(" & ", " and ")
    text = sub(r"^\d{8,}(?=[A-Z])", "", text)
    text = sub(r"'+", "'", text).replace("'sa ", "'s a ").replace("%", " % ")
    text = sub(r"(?:(?<= )|^)(?:\d+[Xx](?=\d+(?:$|[ /Xx×])))+", lambda m: re.sub("[Xx]", " x ", m[0]), text)
    text = sub(r"(?<=\d)(century|army)(?= |$)", r"th \1", text)
    text = sub(r"(?<=\w)\(", " (", text)
    text = sub(r"\)(?=\w)", ") ", text)
    text = sub(r"([a-zA-Z]{2}\.)(?=\d)", r"\1 ", text)
    text = sub(r",(?=[a-zA-Z])", ", ", text)
    text = sub(r"(?<=\W)milion(?=\W)", "million", text)
    text = sub(r"(\W&\s*)Co(?=[^\w.-])", r"\1Co.", text)
    text = sub(r"(\WU\.S)(?=[^.\w])", r"\1.", text)
    text = sub(r"\$(?: +(?=\d)|#)", "$", text)
    text = sub(r" #(\d+)(?= |$)", r" number \1", text)
    text = sub(r"([^\s</])(/+)\s", r"\1 \2 ", text)
    text = sub(r"(\d)/1,000(?=[^\d,])", r"\1/1000", text)
    text = sub(r"\n\. 's ", "'s ", text).replace(" 's ", "'s ")
    return trim_blanks(text.replace("\t", " "))


def process_ing(text: str) -> str:
    """``goin'`` -> ``going``, ``go'ing`` -> ``going``."""
    text = sub(rf"{BEGIN}([^\W\d_]+in)'{END}", r"\1g", text, re.I)
    return sub(rf"{BEGIN}([^\W\d_]+)'ing{END}", r"\1ing", text, re.I)


def process_d(text: str) -> str:
    """``'d`` joins its pronoun, or ends a verb as -ed."""

    def end(m: re.Match) -> str:
        w = m[1]
        if w.lower() in ("i", "you", "he", "she", "we", "they", "one"):
            return w + "'d"
        return w + ("d" if w.endswith("e") else "ed")

    return sub(rf"{BEGIN}([a-z]+|I) ?'d{END}", end, text)


def complex_abbreviations(text: str) -> str:
    """``XX Century`` -> ``20th Century``; ``x+`` -> ``x plus``."""

    def century(m: re.Match) -> str:
        return f"{roman.decimal(m[1].rstrip('.e'), True)}th {m[2]}"

    text = sub(rf"{BEGIN}([XVI]+[.e]?) (Century|Corps){END}", century, text)
    text = sub(r"([A-Za-z0-9]) ?\+", r"\1 plus ", text)
    text = sub(rf"plus +\+(?:{END}|(?=[-+]))", "plus plus", text)
    return trim_blanks(text)


_WEB = re.compile(
    r"http|www|ftp|@|\.(?:org|net|com|fr|uk|gov|pdf|php|co|be|de|ppt|ch|jpg|gouv|asso|qc|ca|htm|asp)"
)
_WEB_TOKEN = re.compile(r"http|www|ftp|[a-zA-Z0-9]@[a-zA-Z0-9]|\.(?:org|net|com|fr|uk|gov|pdf|php3|co|be|de|ppt)")
_SUFFIXES = "com fr org ppt jpg pdf gov uk qc de ca ch net th html htm asp php".split()
_SIGNS = {".": "dot", "/": "slash", ":": "colon", "-": "dash", "_": "underscore", "~": "tilde", "@": "at"}


def repair_url(line: str) -> str:
    """Blanks inside addresses removed."""
    line = sub(r"htt(?:p)?\s*:\s*/\s*/\s*", " http://", line)
    line = sub(r"\b(?:www|WWW)\s*\.\s*", "www.", line)
    line = sub(r"(?<=\w)\.www\.", ". www.", line)
    line = sub(r"\bftp\.\s+", "ftp.", line)
    line = sub(r"\s*/\s+|\s+/", "/", line)
    line = sub(rf"\s*\.\s+({'|'.join(_SUFFIXES)})\b", r".\1", line)
    line = sub(r"\s+\.(org|html?)\b", r".\1", line)
    line = sub(r"\s*\.\s*(gouv|asso)\s*\.\s*fr\b", r".\1.fr", line)
    line = sub(r"\.\s+HTM\b", ".htm", line)
    line = sub(r"\s+(?:\[at\]|@)\s+", "@", line)
    line = sub(r"http://(\d+) (\d+) (\d+) (\d+)", r"http://\1.\2.\3.\4", line)
    return sub(r"\s+", " ", line)


def spell_url(token: str, lexicon: Lexicon | None = None, signs: dict[str, str] = _SIGNS) -> str:
    token = sub(f"({LETTER})(?={CAPITAL_OR_DIGIT}[a-z0-9])", r"\1 ", token)
    token = sub(f"({CAPITAL})(?={CAPITAL}{LETTER})", r"\1 ", token)
    token = sub(r"([A-Za-z])(?=\d)", r"\1 ", token)
    token = token.replace("//", f" double {signs['/']} ")
    for sign, word in signs.items():
        token = token.replace(sign, f" {word} ")
    token = sub(r"(\d+)", r" \1 ", token)
    return " ".join(w.lower() for w in token.split())


#: Blank characters other than the blank and the line feed.
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) - {" ", "\n"}


def url(text: str, signs: dict[str, str] = _SIGNS) -> str:
    """Addresses repaired, spelled out and tagged."""
    out = []
    spaced = "  " in text or not characters(text).isdisjoint(_SPACES)
    for line in text.split("\n"):
        line = compiled(r"\s+").sub(" ", line) if spaced else line
        if _WEB.search(line):
            words = repair_url(line).split()
            line = " ".join(f"<URL> {spell_url(w, signs=signs)} </URL>" if _WEB_TOKEN.search(w) else w for w in words)
        out.append(line)
    return "\n".join(out)


def _era(mark: str | None) -> str:
    letters = (mark or "").replace(".", "").upper()
    return {"AD": " AD", "BC": " before Christ"}.get(letters, "")


def month_name(text: str) -> str:
    """A month's number or short form as its name."""
    if text.isdigit():
        return MONTHS[int(text) - 1] if 1 <= int(text) <= 12 else text
    return _SHORT.get(text.rstrip(".").capitalize(), text)


def month_number(text: str) -> str:
    """A month's name as its number; other texts stay."""
    names = [m.lower() for m in MONTHS]
    return str(names.index(text.lower()) + 1) if text.lower() in names else text


def full_year(text: str) -> str:
    n = int(text)
    if n < 10:
        return f"20{n:02d}"
    return f"19{n:02d}" if n < 100 else str(n)


def date(month: str, day: str, year: str, era: str | None = None) -> str:
    """``the second of May nineteen eighty-four``, tagged."""
    said = num.year(full_year(year)) if not era else num.year(year)
    name = month_name(month) if month else ""
    body = f"the {num.ordinal(str(int(day)))} of {name} {said}" if day else f"{name} {said}"
    return tag("DATE", body + _era(era))


def time(hour: str, minute: str = "", second: str = "", half: str = "") -> str:
    """Clock time in words, tagged."""
    h, m, s = int(hour), int(minute or 0), int(second or 0)
    part = half.replace(".", "").upper()[:1]
    if not m and not s and h in (12, 24):
        said = "midnight" if h == 24 or part == "A" else "noon"
        return tag("TIME", said)
    name, following = num.cardinal(str(h)), num.cardinal(str((h + 1) % 12))
    if s:
        said = f"{name} {num.cardinal(str(m))} and {num.cardinal(str(s))}"
    elif not m:
        said = f"{name} o'clock"
    elif m in (15, 30):
        said = ("quarter" if m == 15 else "half") + f" past {name}"
    elif m == 45:
        said = f"quarter to {following}"
    else:
        said = f"{num.cardinal(str(60 - m))} to {following}" if m > 30 else f"{num.cardinal(str(m))} past {name}"
    if part == "P":
        said += " at night" if h > 8 else " in the evening" if h > 5 else " in the afternoon"
    elif part == "A":
        said += " in the morning"
    return tag("TIME", said)


def duration(parts: dict[str, str | None]) -> str:
    """``2 hours 5 minutes`` from unit names and numbers; zero parts are left out."""
    return " ".join(f"{n} {unit}{num.plural(n)}" for unit, n in parts.items() if n and float(n))


def decade(text: str) -> str:
    return text[:-2] + "ties" if text.endswith("ty") else text


_D, _H, _M = r"(?:days?|d \.|d\.?)", r"(?:hours?|h \.|h\.?)", r"(?:minutes?|min ?\.?|mn ?\.?|')"
_S, _MS = r"(?:seconds?|sec ?\.?|s \.|s\.?|'')", r"(?:milliseconds?|ms ?\.?)"
_FREE = r"(?<![\w.])"
_PLURAL = rf" ?'?s(?:{END}|(?=-))"
_STOP = r"(?= |/|\n|\Z)"


def durations(text: str, units=("day", "hour", "minute", "second", "millisecond"), marks=(_D, _H, _M, _S, _MS)) -> str:
    day, hour, minute, second, milli = marks
    tail = rf"(?: ?(\d+\.?\d*) ?{second}(?: ?(\d+\.?\d*) ?{milli})?)?"

    def say(first: int):
        return lambda m: duration(dict(zip(units[first:], m.groups())))

    text = sub(rf"\b(\d+) ?{day} ?(\d+) ?{hour}(?: ?(\d+) ?{minute}{tail})?{_STOP}", say(0), text)
    text = sub(rf"\b(\d+) ?{hour} ?(\d+) ?{minute}{tail}{_STOP}", say(1), text)
    text = sub(rf"\b(\d+) ?{minute} ?(\d+\.?\d*) ?{second}(?: ?(\d+\.?\d*) ?{milli})?{_STOP}", say(2), text)
    return sub(rf"\b(\d+\.?\d*) ?{second} ?(\d+\.?\d*) ?{milli}{_STOP}", say(3), text)


def date_and_time(text: str) -> str:
    """Dates, years, decades, clock times and durations in words, tagged."""
    i = re.I
    text = sub(
        rf"{BEGIN}({_DAY_NAME}),? *((?:the )?) *({_DAY})(?:th|rd|st|nd)?,? *((?:of )?) *({_MONTH})(?: ?, ?| )?(\d{{4}})?{END}",
        lambda m: tag("DATE", f"{m[1]} {m[2]}{num.ordinal(m[3])} {m[4]}{month_name(m[5])} {num.year(m[6]) if m[6] else ''}"),
        text,
        i,
    )
    text = sub(rf"{BEGIN}({_MONTH}) (?:, )?(19\d\d|20\d\d){END}", lambda m: tag("DATE", f"{month_name(m[1])} {num.year(m[2])}"), text, i)
    text = sub(
        rf"{BEGIN}({_SINCE}) ({_MONTH}) (?:, )?(\d{{3,4}}){END}",
        lambda m: f"{m[1]} {tag('DATE', f'{month_name(m[2])} {num.year(m[3])}')}",
        text,
        i,
    )
    text = sub(rf"{BEGIN}({_MONTH}) ?({_DAY})(?:st|nd|rd|th)? ?(?:, ?)?(\d{{3,4}}){END}", lambda m: date(m[1], m[2], m[3]), text, i)
    text = sub(rf"{BEGIN}({_SINCE}) +([12][0-7]\d\d|20\d\d){END}", lambda m: f"{m[1]} {tag('DATE', num.year(m[2]))}", text, i)
    text = sub(rf"{BEGIN}({_WHEN}) (midnight|noon){END}", lambda m: f"{m[1]} {tag('TIME', m[2])}", text, i)
    text = sub(
        rf"{BEGIN}({_WHEN}) ({_SMALL} (?:o'clock|in the (?:morning|afternoon|evening|night)|[AP]M|[AP]\.M\.)){END}",
        lambda m: f"{m[1]} {tag('TIME', m[2])}",
        text,
        i,
    )
    text = sub(rf"{BEGIN}({_DAY})?( ?[-./ ] ?)({_MONTH})\2([12]?\d?\d\d){END}", lambda m: date(m[3], m[1] or "", m[4]), text, i)
    # the month first, then the day first; blanks separate only plausible years
    text = sub(rf"{BEGIN}({_MONTH_NUMBER})( ?[-./] ?)({_DAY})\2([12]?\d?\d\d){END}", lambda m: date(m[1], m[3], m[4]), text)
    text = sub(rf"{BEGIN}({_DAY})( ?[-./] ?)({_MONTH_NUMBER})\2([12]?\d?\d\d){END}", lambda m: date(m[3], m[1], m[4]), text)
    text = sub(rf"{BEGIN}({_MONTH_NUMBER}) +({_DAY}) +(20\d\d|1[6-9]\d\d){END}", lambda m: date(m[1], m[2], m[3]), text)
    text = sub(rf"{BEGIN}({_DAY}) +({_MONTH_NUMBER}) +(20\d\d|1[6-9]\d\d){END}", lambda m: date(m[2], m[1], m[3]), text)
    century = r"(?:18|19|20)\d\d"
    text = sub(rf"{BEGIN}({century}) ?- ?({century}){END}", lambda m: f"{tag('DATE', num.year(m[1])).strip()} - {tag('DATE', num.year(m[2])).strip()}", text)
    text = sub(rf"{BEGIN}([1-9]\d{{1,3}}) ?({ERA})(?=\W|\Z)", lambda m: date("", "", m[1], m[2]), text)
    text = sub(rf"{_FREE}(?:19)?([2-9]0){_PLURAL}", lambda m: tag("DATE", decade(num.year(m[1]))), text)
    text = sub(rf"{_FREE}(1[678][2-9]0){_PLURAL}", lambda m: tag("DATE", decade(num.year(m[1]))), text)
    text = sub(rf"{BEGIN}(\d{{3,4}})-(\d{{3,4}}){END}", lambda m: f"{tag('DATE', num.year(m[1])).strip()} - {tag('DATE', num.year(m[2])).strip()}", text)
    text = sub(rf"(?:(?<=[ \n-])|(?<![\s\S]))({MODERN})(?:{END}|(?=-))", rf" {YEAR_MARK} \1 ", text)
    text = sub(rf"</DATE> -present{END}", "</DATE> until present", text)
    text = text.replace("</DATE> - <DATE>", "</DATE> to <DATE>")
    half = r"([AP])\.?M\.?"
    text = sub(rf"{BEGIN}({HOUR}(?:(?:\.| *: *)?[0-5]\d)?) ?({half})-({HOUR}(?:(?:\.| *: *)?[0-5]\d)?) ?({half}){END}", r"\1 \2 to \4 \5", text, i)
    text = sub(
        rf"{BEGIN}({HOUR}){COLON}({MINUTE})(?:{COLON}({MINUTE}))?\s?{half}{END}",
        lambda m: time(m[1], m[2], m[3] or "", m[4]),
        text,
        i,
    )
    text = sub(rf"{BEGIN}({HOUR})([0-5]\d)? ?{half}{END}", lambda m: time(m[1], m[2] or "", "", m[3]), text, i)
    text = sub(rf"{BEGIN}([01]\d|2[0-4]){COLON}([0-5][05]){END}", lambda m: time(m[1], m[2]), text)
    text = durations(text)
    text = sub(rf"{BEGIN}({HOUR}) *[hH] *([0-5]\d)?(?: ?{half})?{END}", lambda m: time(m[1], m[2] or "", "", m[3] or ""), text)
    return trim_blanks(text)


_MANY = {"b": "billion ", "m": "million ", "M": "million ", "": ""}


def currencies(text: str, units: tuple[Unit, ...] = ENGLISH_CURRENCIES, spelled: str = _SPELLED, many: dict[str, str] = _MANY) -> str:
    """``$5m`` -> ``5 million dollars``, tagged."""
    by_symbol = {u.symbol.lower(): u for u in units}
    symbols = alternation(u.symbol for u in units)
    sure = alternation(u.symbol for u in units if u.reliable)
    i = re.I
    text = sub(rf"{YEAR_MARK} (\d+) ({symbols})(?=\.?(?:'s| |/|\n|\Z))", r"\1 \2", text, i)
    text = sub(rf"(?<![\w.])({symbols}) ?(\d+(?:[.,/][\d-]+)*)(?: *([Mbm])(?:illion|n)?)?\.?{AFTER}", r"\2 \3 \1", text)
    text = sub(rf"{BEGIN}(\d+)\.?- *({symbols}){END}", r"\1 \2", text, i)

    def say(m: re.Match) -> str:
        unit, more = by_symbol[m[3].lower()], many[m[2] or ""]
        return f"{m[1]} {more}{unit.of(m[1], bool(more))}"

    text = sub(rf"(?<![\w.,])({NUMBER}) ?([bmM]?) ?({sure})\.?(?:{END}|(?=/))", say, text)
    names = alternation(n for u in units for n in (u.singular, u.plural))
    scale = "|".join(w.strip() for w in many.values() if w.strip())
    text = sub(rf"{BEGIN}{NUMBER} (?:(?:{scale})s? )?(?:{names}){END}", lambda m: tag("CURRENCY", m[0]), text)
    if holds(rf"{BEGIN}(?:{names}){END}", text):
        text = sub(rf"{BEGIN}(?<!> )(?:{spelled}) (?:{names}){END}", lambda m: tag("CURRENCY", m[0]), text)
    return trim_blanks(text)


_POWER = {"2": "square", "²": "square", "3": "cubic", "³": "cubic", "sq": "square", "cu": "cubic"}


def units(
    text: str,
    table: tuple[Unit, ...] = ENGLISH_UNITS,
    spelled: str = _SPELLED,
    per: str = "per",
    degree: str = "degree",
    power: dict[str, str] = _POWER,
    power_after: bool = False,
    ordinals: str = "",
) -> str:
    """``10 m/s`` -> ``10 meters per second``, tagged; letters of ``ordinals`` after a number stay."""
    by_symbol = {u.symbol: u for u in table}
    symbols = alternation(u.symbol for u in table)
    sure = alternation(u.symbol for u in table if u.reliable)
    text = sub(rf"{YEAR_MARK} (\d+) ({symbols})(?=\.?(?:'s| |/|\n|\Z))", r"\1 \2", text)
    for letter, scale in (("C", "Celsius"), ("F", "Fahrenheit")):
        text = sub(rf"\b({NUMBER}) *° ?{letter}{END}", lambda m: f"{m[1]} {degree}{num.plural(m[1])} {scale}", text)
    text = sub(rf"\b({NUMBER}) *fl ?\.? ?oz ?\.?{END}", lambda m: f"{m[1]} fluid ounce{num.plural(m[1])}", text, re.I)
    text = sub(rf"\b({NUMBER})in\.?{END}", r"\1 in.", text)
    text = sub(r"\b3\" *1/2 ", "3.5 inches ", text)
    text = sub(r"\b5\" *1/4 ", "5 inches and a quarter ", text)
    text = sub(rf"\b(\d+)[.](\d0) ?m[.]?{END}", r"\1 m \2", text)
    text = sub(rf"\b(\d+)m(\d+){END}", r"\1 m \2", text)
    text = sub(rf"\b({NUMBER}) ?[xX] ?({NUMBER}) ?({sure})(?=[^\w]|\Z)", r"\1 x \2 \3", text)

    def name(number: str, symbol: str, exponent: str | None, one: bool = False) -> str:
        unit = by_symbol[symbol]
        said = unit.singular if one else unit.of(number)
        word = power.get((exponent or "").strip(" ."), "")
        if not word:
            return said
        return f"{said} {word}" if power_after else f"{word} {said}"

    sq = r"(?:(sq|cu)\.? )?"
    text = sub(
        rf"(?<![\w.,])({NUMBER}) ?{sq}({symbols})([23²³]?)\.? ?/ ?{sq}({symbols})([23²³]?)(?= |/|\n|\Z)",
        lambda m: f"{m[1]} {name(m[1], m[3], m[2] or m[4])} {per} {name('1', m[6], m[5] or m[7], True)}",
        text,
    )
    text = sub(
        rf"(?<![\w.,])({NUMBER}) ?({symbols})(?: ?\. ?| )({symbols}) ?-1(?= |/|\n|\Z)",
        lambda m: f"{m[1]} {name(m[1], m[2], None)} {per} {name('1', m[3], None, True)}",
        text,
    )
    text = sub(
        rf"(?<![\w.,])({NUMBER}) ?{sq}({sure})([23²³]?)\.?(?= |/|\n|\Z)",
        lambda m: f"{m[1]} {name(m[1], m[3], m[2] or m[4])}",
        text,
    )
    text = sub(rf"\b(\d+)(?![{ordinals or ' '}])([{LO}]){END}", lambda m: m[1] + m[2].upper(), text)
    text = sub(rf"\b(\d+)([{LO}]{{4,}}|[A-Z][{LO}]{{3,}})", r"\1 \2", text)
    text = trim_blanks(text)
    words = alternation([n for u in table for n in (u.singular, u.plural)] + ["fluid ounce", "fluid ounces"])
    shape = "(?:" + "|".join(sorted(set(power.values()))) + ")"
    one = rf"(?:{words})(?: {shape}s?)?" if power_after else rf"(?:{shape} )?(?:{words})"
    amount = rf"{one}(?: {per} {one})?"
    text = sub(rf"{BEGIN}(?:{NUMBER} [xX] )?{NUMBER} {amount}{END}", lambda m: tag("QUANTITY", m[0]), text)
    text = sub(rf"{BEGIN}({NUMBER})-((?:{words})){END}", lambda m: tag("QUANTITY", f"{m[1]} {m[2]}"), text)
    if holds(rf"{BEGIN}(?:{words})(?:{END}|(?= ))", text):
        text = sub(rf"{BEGIN}(?<!> )(?:{spelled}) {amount}{END}", lambda m: tag("QUANTITY", m[0]), text)
    text = sub(r" </QUANTITY> +<QUANTITY> ", " ", text)
    return trim_blanks(text)


def hyphenate(text: str, lexicon: Lexicon) -> str:
    """Hyphens kept in names and listed words; split words mended; others become blanks."""
    keep = ""

    def cut(w: str) -> str:
        if compiled(r"-.*-").fullmatch(w):
            return w
        if compiled(rf"[{UP}]\.?.*-[A-Z0-9]").match(w) or w in lexicon:
            return w.replace("-", keep)
        m = compiled(HALVES + "?)(?:'s?)?").fullmatch(w)
        if m and (m[2] + m[3] in lexicon or (m[2] + m[3]).lower() in lexicon):
            return m[1] + m[2] + m[3]
        return w

    text = sub(rf"{BEGIN}-([^ \d\n]+)(?= |\n|\Z)", r"\1", text)
    text = sub(r"--+", " - ", text)
    text = sub(r" +- +", " ", text)
    text = sub(r"^- +", " ", text)
    text = sub(r"(?<=\d)-(?=\d)", " ", text)
    text = sub(rf"{BEGIN}[^ \n-]+(?:-[^ \n]+)+(?= |\n|\Z)", lambda m: cut(m[0]), text)
    return trim_blanks(sub(rf" *{keep}", "-", text.replace("-", " ")))


def apostrophes(text: str, lexicon: Lexicon) -> str:
    """Genitives and contractions kept, quoting marks dropped."""
    keep = ""
    text = sub(r"([A-Za-z0-9])(?:' s| 's)\b", r"\1's", text)
    text = sub(rf"{BEGIN}' <([A-Z]+)> (.+) (</\1>) '{END}", r"<\1> \2 \3", text)
    text = sub(rf" ({CLOSED}) +'({LETTER}{{1,2}}){END}", r"'\2 \1", text)
    text = sub(r" (</[A-Z]+>) +'(?= |\n|\Z)", r"' \1", text)
    text = sub(r" 's\b", f" {keep}s", text)
    for _ in range(2):
        text = sub(rf"{BEGIN}'(.+)'{END}", r"\1", text)
    text = sub(rf" '(d|ve|re|ll|s){END}", rf" {keep}\1", text)

    def cut(w: str) -> str:
        if w[0].isupper() or w in lexicon or compiled(r".*'(?:[std]|ve|ll|re|m)").fullmatch(w):
            return w.replace("'", keep)
        if w.endswith("s'"):
            return w[:-1] + keep
        return w

    text = sub(rf"{BEGIN}[^\s<>]*'[^\s]*", lambda m: cut(m[0]), text)
    text = text.replace("'", " ").replace(keep, "'")
    for who, ends in (("he|she", "d|ll|s"), ("we|you|they", "d|ll|re|ve"), ("I", "d|ll|m|ve")):
        text = sub(rf"{BEGIN}({who}) '({ends}){END}", r"\1'\2", text)
    text = sub(r"S'(?= |\n|\Z)", "S's", text)
    return sub(r"(?<=[^Ss\s])'(?= |\n|\Z)", "", text)


def roman_numbers(text: str, lexicon: Lexicon) -> str:
    """Marked numerals as numbers, after names as ordinals, long ones always."""

    def nth(numeral: str, forced: bool = False) -> str:
        value = roman.to_int(numeral, forced)
        return numeral if value is None else f"the {value}{'th'}"

    text = sub(rf"{ROMAN_MARK} ([IVXLCDM]+)", lambda m: f" {roman.decimal(m[1])} ", text)
    text = sub(rf"({NAME}) </PERSON> ([IV]+(?:'s|)){AFTER}", r"\1 \2 </PERSON>", text)
    text = sub(
        rf"<PERSON> ({NAME}(?: {NAME})?) ([IV]+)(?='s|\.? <)",
        lambda m: f"<PERSON> {m[1]} {nth(m[2], True)}",
        text,
    )
    text = sub(rf"\b({NAME}) ({NUMERAL}+)(?='s| |$)", lambda m: f"{m[1]} {nth(m[2])}", text)

    def alone(m: re.Match) -> str:
        name, rest = m[1], m[2]
        known = name.lower() in lexicon
        if rest[:1].isupper():
            said = "I" if known else "the 1st" if "NP" in lexicon.tags(name) else "1"
        elif rest[:1].islower():
            said = "1" if known else "the 1st"
        else:
            said = "1" if known and not lexicon.tags(name) & {"NP", "SYM"} else "I"
        return f"{name} {said}" + (f" {rest}" if rest[:1].isalpha() else rest)

    text = sub(rf"\b({NAME}) I (?=([A-Za-z]{LETTER}*)(?='s| |$))", lambda m: alone(m)[: -len(m[2])] if m[2] else m[0], text)
    text = sub(rf"\b({NAME}) I( ?\.{AFTER}|(?=\n|\Z))", alone, text)
    text = sub(r"(?:(?<= )|^)(?<!<ORGANIZATION> )([IVXLCDM]{3,})(?=\.| |$)", lambda m: roman.decimal(m[1]), text)
    text = sub(r"(?<=\d)(st|th)\.", r"\1 .", text)
    return trim_blanks(text)


def numbers(text: str, lexicon: Lexicon) -> str:
    """All remaining digits in words."""
    say, nth = num.cardinal, num.ordinal
    i = re.I
    text = sub(rf"{YEAR_MARK} ({MODERN})(?:{END}|(?=-))", lambda m: tag("DATE", num.year(m[1])), text)
    text = sub(
        rf"\b(after|before|from|in|to|until|year) (20\d\d|1[3-9]\d\d){END}",
        lambda m: f"{m[1]} {tag('DATE', num.year(m[2]))}",
        text,
        i,
    )
    text = sub(r"(?<=\d),(?=\d{3}(?: |$))", "", text)
    text = sub(rf"(?<!\d)(\d+(?:st|nd|rd|th)?)(?={_MONTH})", r"\1 ", text)
    text = sub(r"(?:(?<= )|^)-(?=\d)", "minus ", text)
    text = sub(r"\+ ?(?=\d)", " plus ", text)
    text = fixpoint(rf"{BEGIN}({NUMBER}) *[xX] *(?={NUMBER}(?:/| |\n|\Z))", r"\1 by ", text)
    text = text.replace(" × ", " times ")
    for sign, word in ((" <= ", "is lower than or equal to"), (" >= ", "is greater than or equal to"), (" < ", "is lower than"), (" <", "less than"), (" > ", "is greater than"), (" >", "more than")):
        text = sub(rf"{sign}(?=\d)", f" {word} ", text)
    text = sub(r" *=+ *", " equals ", text)
    text = sub(r"(?<![\d/])1/2(?![\d/])", "a half", text)
    text = sub(r"(?<![\d/])([12])/3(?![\d/])", lambda m: f"{say(m[1])} third{num.plural(m[1])}", text)
    text = sub(r"(?<![\d/])1/4(?![\d/])", "one quarter", text)
    text = sub(r"(?<![\d/])3/4(?![\d/])", "three quarters", text)
    text = sub(r"\b(\d{1,2})(ers?)\b", lambda m: sub(r"e$", "", say(m[1])) + m[2], text)
    text = sub(r"\bI ?st\b", "first", text)
    text = sub(r"\b(\d*(?:1 ?st|2 ?nd|3 ?rd))\b", lambda m: nth(re.sub(r"\D", "", m[1])), text)
    text = sub(r"\b(\d+) ?-?th(s?)\b", lambda m: nth(m[1]) + m[2], text)
    text = sub(r"\b(\d+) */ *([1-9]\d)\b(?![.,]\d)", lambda m: f"{say(m[1])} {nth(m[2])}{num.plural(m[1])}", text)
    decimal = r"\d+(?:[.,]\d+)*"
    text = sub(rf"\b({decimal}) */ *({decimal})\b", lambda m: f"{say(m[1]) or m[1]} out of {say(m[2]) or m[2]}", text)
    text = sub(rf"{BEGIN}(?:\d+\.){{2,}}(?=\d| |\n|\Z)", lambda m: m[0].replace(".", " "), text)
    text = sub(rf"{BEGIN}({decimal})(?=[- \n]|\Z)", lambda m: say(m[1]) or m[1], text)
    text = sub(
        rf"{BEGIN}({decimal})\.([A-Za-z]+) ",
        lambda m: f"{say(m[1]) or m[1]} . {first_letters(m[2], lexicon)} ",
        text,
    )
    return trim_blanks(text)


def end(text: str, spell=num.cardinal, and_word: str = "and", plus: str = "plus", slash: str = "slash", dot: str = "dot", elision: bool = False) -> str:
    """Leftovers: stray signs, dots, hyphens, digits and single letters.

    Where words are elided, single letters before an apostrophe stay as they are, the
    word ``y`` too, and parentheses go.
    """
    edge = "(?= |\n|\\Z|'[sS])" if elision else END
    single = "b-xz" if elision else "b-z"
    text = sub(rf"([{LO}]) \+ (?=[{UP}])", rf"\1 {and_word} ", text)
    text = sub(rf"([{UP}]) \+ ?", rf"\1 {plus} ", text).replace("+", " ")
    text = sub(r"^%", "", text).replace("&amp", " & ")
    text = sub(r"^Page ", "page ", text)
    text = sub(r"(?:(?<= )|^)(\d+)([Aa]nd|[Tt]he) ", lambda m: f"{m[1]} {m[2].lower()} ", text)
    text = text.replace(YEAR_MARK, " ")
    text = sub(rf"{BEGIN}\.([a-z]+){END}", lambda m: f"{dot} {m[1].lower()}", text, re.I)
    text = sub(rf"{BEGIN}\.+([^. \n]+)\.+{END}", r"\1", text)
    text = sub(r"(?:(?<= )|^)\.(?=[^. \n])", "", text)
    text = sub(rf"([a-z]{{2}})\.{END}", r"\1", text)
    text = text.replace(";", ",")
    text = sub(r"[()]", " ", text) if elision else text
    text = sub(r"[^\w'\"+\-!,:¡¿?.\n&<>/ ()]|(?<!<)/", " ", text)
    text = text.replace(" & ", f" {and_word} ")
    text = sub(r" &+", " ", text)
    text = sub(rf"{BEGIN}'(\w\.?){END}", r"\1", text)
    text = sub(r"(?:(?<= )|^)\.(?=\d)", "", text)
    text = trim_blanks(text)
    text = sub(r"(?<![<\w/])(\w+)>(?= |\n|\Z)", r"\1", text)
    text = sub(r"(?:(?<= )|^)- ", "", text)
    text = sub(r" -$", "", text)
    text = sub(rf"\b({CAPITAL_OR_DIGIT}[.]?(?:[\da-zA-Z-][.]?)+)-{AFTER}", r"\1", text)
    text = sub(r"(?:(?<= )|^)-(?=[A-Z0-9])", "", text)
    text = sub(rf" ([!?.]) '([a-z]{{1,2}}){END}", r"'\2 \1", text)
    text = sub(rf" ({CLOSED}) *'({LETTER}{{1,2}}){END}", r"'\2 \1", text)
    text = sub(rf" '([st]){END}", r"'\1", text)
    text = sub(r"(?:(?<= )|^)/", f"{slash} ", text)
    text = sub(rf"{BEGIN}([^\W_]+)[Tt][Vv]{END}", r"\1T.V.", text) if compiled(rf"{BEGIN}[^\W_]+TV{END}").search(text) else text
    text = sub(rf"{BEGIN}(\d+(?:[.,]\d+)*){END}", lambda m: spell(m[1]) or m[1], text)
    text = sub(r"(?<!\.)\.\.(?!\.)", ".", text)
    text = sub(rf"{BEGIN}([{single}]){edge}", lambda m: m[1].upper() + ".", text)
    text = sub(rf"{BEGIN}([a-z]\.){END}", lambda m: m[1].upper(), text)
    text = sub(rf"(?:(?<=[ -])|^)([B-HJ-Z]){edge}", r"\1.", text)
    text = sub(rf"{BEGIN}(\d+)([a-z]+){END}", lambda m: m[1] + "".join(c.upper() + "." for c in m[2]), text)
    text = text if elision else sub(rf"{BEGIN}([A-Z])\.?'(?= |\n|\Z)", r"\1.", text)
    text = sub(r" - ", " ", text)
    text = sub(r" -$|^- ", "", text)
    return trim_blanks(text)


WEAK = r"[,;:()¡¿]"


def drop_weak_punctuation(text: str) -> str:
    return trim_blanks(sub(WEAK, " ", text))
