"""Lexicons, parts of speech, units and currencies; all can be replaced.

The built-in ones are small and hand-written: enough for function words, common
words and usual units.  Files of the same form load with ``sources.resources``.
"""

from __future__ import annotations

import dataclasses

_EN_CLOSED = {
    "DET": "the a an this that these those my your his her its our their each every some any no both all",
    "PRO": "i you he she it we they me him us them who whom which what there one",
    "P": "of in on at by for with from to into through during after before since until under over between among about against without within towards",
    "CJ": "and or but if because while although when where whereas unless nor so yet as than",
}
_EN_COMMON = """
scientific participation project projects management organization organisation research activity activities programme
program programs publication publications number objective level area place scale network partner partners university
public private centre center company page pages strategy development conference conferences information system systems
work works world year years day days time people man woman child life hand part case week government system question
point home water room mother money story fact month lot right study book eye job word business issue side kind head
house service friend father power hour game line end member law car city community name president team minute idea body
nothing thing school state family student group country problem good new first last long great little own other old
big high different small large next early young important few same able be have do say get make go know take see come
think look want give use find tell ask seem feel try leave call will can must may might should would could is are was
were been being has had does did very also just only even still again now then here how why well not never always
international national global economic main wide best center is-land example aspirin exam word test text house-hold
city scientific yesterday today tomorrow morning evening night price prices report reports million sale sales
"""
_FR_CLOSED = {
    "DET": "le la les un une des du ce cet cette ces mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs chaque quelques plusieurs l' d'",
    "PRO": "je tu il elle on nous vous ils elles qui que quoi dont où moi toi lui eux celui celle ceux c' j' n' s' qu'",
    "P": "de à en dans par pour sur avec sans sous entre vers chez depuis pendant durant avant après contre dès",
    "CJ": "et ou mais donc or ni car si comme quand lorsque puisque quoique",
}
_FR_COMMON = """
activités activité concernent particulier compression images image vidéos vidéo recherche fondamentale organismes
internationaux autres travaux analyse scènes octobre siècle ans personnes environ chercheurs doctorants ingénieurs
techniciens administratifs centre très lié moins mètres mètre heure heures jour jours année années temps homme femme
enfant vie monde pays ville travail maison main chose fois point groupe nombre problème question état partie grand
petit bon nouveau premier dernier autre même tout plus bien être avoir faire dire aller voir savoir pouvoir vouloir
est sont était ont a fête fêté comprend aujourd'hui quelqu'un arc-en-ciel rendez-vous
"""


@dataclasses.dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    pos: dict[str, frozenset[str]]
    proper: frozenset[str] = frozenset()

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def tags(self, word: str) -> frozenset[str]:
        return self.pos.get(word, frozenset())


def _built_in(closed: dict[str, str], common: str) -> Lexicon:
    pos: dict[str, set[str]] = {}
    for tag, words in closed.items():
        for w in words.split():
            pos.setdefault(w, set()).add(tag)
    words = set(pos) | set(common.split())
    return Lexicon(frozenset(words), {w: frozenset(t) for w, t in pos.items()})


ENGLISH = _built_in(_EN_CLOSED, _EN_COMMON)
FRENCH = _built_in(_FR_CLOSED, _FR_COMMON)


@dataclasses.dataclass(frozen=True)
class Unit:
    symbol: str
    singular: str
    plural: str
    reliable: bool = True

    def of(self, number: str, many: bool = False) -> str:
        try:
            value = abs(float(number.replace(",", "")))
        except ValueError:
            value = 2.0
        return self.plural if many or value >= 2 else self.singular


def _units(*rows: str, suffix: str = "s") -> tuple[Unit, ...]:
    out = {}
    for row in rows:
        symbols, _, rest = row.partition(":")
        names = rest.split("/")
        one = names[0].strip()
        more = names[1].strip() if len(names) > 1 and names[1].strip() else one + suffix
        for s in symbols.split():
            out[s.lstrip("?")] = Unit(s.lstrip("?"), one, more, not s.startswith("?"))
    return tuple(sorted(out.values(), key=lambda u: (-len(u.symbol), u.symbol)))


ENGLISH_UNITS = _units(
    "km kms Km: kilometer",
    "cm: centimeter",
    "mm: millimeter",
    "m: meter",
    "kg Kg: kilogram",
    "g: gram",
    "mg: milligram",
    "ha: hectare",
    "L ?l: liter",
    "ml mL: milliliter",
    "cl cL: centiliter",
    "?t ?T: ton",
    "V: volt",
    "kW: kilowatt",
    "W: watt",
    "Hz: hertz/hertz",
    "kHz: kilohertz/kilohertz",
    "MHz: megahertz/megahertz",
    "GHz: gigahertz/gigahertz",
    "kB KB: kilobyte",
    "MB: megabyte",
    "GB: gigabyte",
    "ft: foot/feet",
    "in.: inch/inches",
    "yd: yard",
    "mi: mile",
    "lb lbs: pound",
    "oz: ounce",
    "mph: mile per hour/miles per hour",
    "kph kmh: kilometer per hour/kilometers per hour",
    "%: percent",
    "sec: second",
    "?s: second",
    "min: minute",
    "?h: hour",
    "pt: point",
)
FRENCH_UNITS = _units(
    "km kms Km: kilomètre",
    "cm: centimètre",
    "mm: millimètre",
    "m: mètre",
    "kg Kg: kilogramme",
    "g: gramme",
    "mg: milligramme",
    "ha: hectare",
    "L ?l: litre",
    "ml mL: millilitre",
    "cl cL: centilitre",
    "?t ?T: tonne",
    "V: volt",
    "kW: kilowatt",
    "W: watt",
    "Hz: hertz/hertz",
    "Go: gigaoctet",
    "Mo: mégaoctet",
    "kmh: kilomètre-heure/kilomètres-heure",
    "%: pour cent",
    "sec: seconde",
    "min: minute",
    "?s: seconde",
    "?h: heure",
)
ENGLISH_CURRENCIES = _units(
    "€ EUR: euro",
    "$ USD: dollar",
    "?¢: cent",
    "¥ JPY: yen",
    "£ GBP: pound",
    "CHF: Swiss franc",
    "DEM DM: German mark",
    "CAD: Canadian dollar",
    "CNY: yuan",
)
FRENCH_CURRENCIES = _units(
    "€ EUR: euro",
    "$ USD: dollar",
    "?¢: cent",
    "¥ JPY: yen",
    "£ GBP: livre",
    "CHF: franc suisse/francs suisses",
    "DEM DM: deutsche mark",
    "CAD: dollar canadien/dollars canadiens",
    "CNY: yuan",
)
PLACES = ("Paris", "London", "Rennes", "New York", "Lausanne", "Geneva", "Berlin", "Madrid", "Lyon", "Boston")
ABBREVIATIONS = frozenset("Mr. Mrs. Dr. St. Prof. Jr. Sr. Inc. Ltd. Co. Corp. etc. vs. e.g. i.e. Jan. Feb. Aug. Sept. Oct. Nov. Dec. Pr. M. Mme. Mlle. No. Vol.".split())
