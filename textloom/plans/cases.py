"""Text steps on sentences with known wording: every order gets a sentence, with a word of
its own, and SQL gives the wording that is expected of it.

``{w}`` is the order's priority in small letters, ``{W}`` the same as a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleaning, english, french
from textloom.functions.arrow import chain, text_function
from textloom.functions.lexicon import ENGLISH, FRENCH
from textloom.functions.tokens import tokenize
from textloom.operators import columns, rules, specific
from textloom.operators.specific import acronyms_exploded, acronyms_exploded_unless_readable
from textloom.plans import normalise, sql
from textloom.plans.catalog import Query, table

Pairs = list[tuple[str, str]]


def sentences(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """o_orderkey, text: the sentences in turn, with the order's word."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")).alias("w"))
    chosen = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % len(texts)).cast("int"))
    return orders.select("o_orderkey", F.replace(F.replace(chosen, F.lit("{w}"), F.col("w")), F.lit("{W}"), F.initcap("w")).alias("text"))


def expected(texts: list[str]) -> str:
    listed = "[" + ", ".join(sql.quote(t) for t in texts) + "]"
    word = "lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g'))"
    return (
        f"SELECT o_orderkey, replace(replace({listed}[o_orderkey % {len(texts)} + 1], '{{w}}', w), '{{W}}', upper(w[:1]) || w[2:]) AS text "
        f"FROM (SELECT o_orderkey, {word} AS w FROM orders)"
    )


def of_frame(step: Callable[[DataFrame], DataFrame], pairs: Pairs) -> Query:
    return Query(lambda spark, sf_dir: step(sentences(spark, sf_dir, [a for a, _ in pairs])).select("o_orderkey", "text"), expected([b for _, b in pairs]))


def of_text(step: Callable[[str], str], pairs: Pairs) -> Query:
    return of_frame(lambda df: df.withColumn("text", text_function(step)("text")), pairs)


def _preset(name: str, lang: str, pairs: Pairs) -> Query:
    return of_frame(lambda df: normalise.normalised(df, name, lang=lang), pairs)


BOOK = rules.RuleBook()
BOOK.load("spelling", ["colour => color"])
BOOK.load("spelling", ["grey => gray"])
BOOK.load("abbreviations", [r"etc\. => et cetera"])

_SPEECH_FR: Pairs = [
    ("L'équipe d'analyse du {w} arrive . Elle part à 8h40 .", "l' équipe d' analyse du {w} arrive .\nelle part à neuf heures moins vingt .\n"),
    ("Au XXIe siècle , {w} vit .", "Au vingt et unième siècle , {w} vit .\n"),
]

QUERIES = {
    "triple_letters_cases": of_frame(
        lambda df: df.withColumn("text", columns.triple_letters(F.col("text"))),
        [("sooo {w} and cooool", "soo {w} and cool"), ("{w} aaah hmmm", "{w} aah hmm"), ("book {w} www", "book {w} www")],
    ),
    "telephone_en_cases": of_text(
        cleaning.telephone,
        [
            ("call 555-1234-777 for {w}", "call <PHONE> triple 5 1 2 3 4 triple 7 </PHONE> for {w}"),
            ("{w} 1990-1995 stays", "{w} 1990-1995 stays"),
            ("{w} at +44-2071-8387", "{w} at <PHONE> plus double 4 2 0 7 1 8 3 8 7 </PHONE>"),
        ],
    ),
    "tokenise_en_cases": of_text(
        tokenize,
        [
            ("The {w}, however, costs 1,234,567 (net).", "The {w} , however , costs 1234567 ( net ) ."),
            ("Is {W} here?Yes!", "Is {W} here ? Yes !"),
            ("see www.{w}.org/a.", "see www.{w}.org/a ."),
            ("{W}|\"quoted\" words... end", "{W} \" quoted \" words ... end"),
            ("10:30: {w} 3.5 and U.S.A.", "{w} 3.5 and USA"),
        ],
    ),
    "tokenise_fr_cases": of_text(
        lambda t: tokenize(t, "fr"),
        [("L'été, {w}: «oui»!", "L'été , {w} : « oui » !"), ("Il a 1,5 {w}; elle (non).", "Il a 1,5 {w} ; elle ( non ) .")],
    ),
    "remove_bugs_en_cases": of_text(
        english.remove_bugs,
        [
            ("5€ & {w}", "5 EUR and {w}"),
            ("{w} #3 50% of", "{w} number 3 50 % of"),
            ("a milion {w},and 3x4", "a million {w}, and 3 x 4"),
            ("louis xiv {w}", "louis XIV {w}"),
        ],
    ),
    "remove_bugs_fr_cases": of_text(french.remove_bugs, [("pain & {w}", "pain et {w}"), ("{w} #3 fin", "{w} dièse 3 fin")]),
    "process_d_cases": of_text(
        english.process_d,
        [("she 'd {w}", "she'd {w}"), ("they {w} and ask'd", "they {w} and asked"), ("it baptise'd {w}", "it baptised {w}")],
    ),
    "compact_initials_cases": of_text(
        lambda t: cleaning.initials(t, ENGLISH),
        [("{w} by J . F . Kennedy today", "{w} by J. F. Kennedy today"), ("{w} of J . R . R . Tolkien , here", "{w} of J. R. R. Tolkien , here")],
    ),
    "compact_acronyms_cases": of_text(cleaning.compact_acronyms, [("the I. B. M. {w}", "the I.B.M. {w}"), ("{w} U. S. A.", "{w} U.S.A."), ("A. {w} b. c.", "A. {w} b. c.")]),
    "first_letter_en_cases": of_text(
        lambda t: cleaning.first_letters(t, ENGLISH),
        [("The {w} is here . And it stays .", "the {w} is here . and it stays ."), ("NATO {w} . He came", "NATO {w} . he came")],
    ),
    "first_letter_fr_cases": of_text(
        lambda t: cleaning.first_letters(t, FRENCH, elision=True),
        [("Le {w} est là . Il reste .", "le {w} est là . il reste ."), ("L'{w} vient", "l'{w} vient")],
    ),
    "complex_abbreviations_en_cases": of_text(
        english.complex_abbreviations, [("the XX Century {w}", "the 20th Century {w}"), ("{w} A+ grade", "{w} A plus grade"), ("the XV. Corps of {w}", "the 15th Corps of {w}")]
    ),
    "complex_abbreviations_fr_cases": of_text(
        french.complex_abbreviations, [("le XXIe {w}", "le 21e {w}"), ("XI siècle {w}", "11e siècle {w}"), ("{w} de Rennes-II ici", "{w} de Rennes 2 ici")]
    ),
    "entity_fixes_cases": of_text(
        cleaning.entity_fixes,
        [("<PERSON> Louis </PERSON> XIV {w}", "<PERSON> Louis XIV </PERSON> {w}"), ("{w} Saint <PERSON> Paul </PERSON>", "{w} <PERSON> Saint Paul </PERSON>")],
    ),
    "bad_tags_cases": of_text(cleaning.drop_bad_tags, [("{w} <PERSON> x </PERSON> y", "{w} <PERSON> x </PERSON> y"), ("{w} <FOO> x", "{w}   x"), ("a <<< {w}", "a   {w}")]),
    "hyphenate_en_cases": of_text(
        lambda t: english.hyphenate(t, ENGLISH), [("a {w}-zzz thing", "a {w} zzz thing"), ("{w} -- then", "{w} then"), ("10-20 {w}", "10 20 {w}"), ("Jean-Paul {w}", "Jean-Paul {w}")]
    ),
    "hyphenate_fr_cases": of_text(
        lambda t: french.hyphenate(t, FRENCH), [("dit-il {w}", "dit -il {w}"), ("va-t-elle {w}", "va -t-elle {w}"), ("rendez-vous {w}", "rendez-vous {w}"), ("Saint-Malo {w}", "Saint-Malo {w}")]
    ),
    "apostrophes_en_cases": of_text(
        lambda t: english.apostrophes(t, ENGLISH), [("the {w}'s end", "the {w}'s end"), ("she 'll go {w}", "she'll go {w}"), ("{w} 'so'", "{w} so"), ("don't {w}", "don't {w}")]
    ),
    "apostrophes_fr_cases": of_text(
        lambda t: french.apostrophes(t, FRENCH), [("l'image du {w}", "l' image du {w}"), ("{w} qu'elle dit", "{w} qu' elle dit"), ("d'un {w} aujourd'hui", "d' un {w} aujourd'hui")]
    ),
    "acronyms_dotted_cases": of_text(
        lambda t: cleaning.acronyms(t, ENGLISH), [("the AFD {w}", "the A.F.D. {w}"), ("{w} F-B-I file", "{w} F.B.I. file"), ("an FA-18 {w}", "an F.A.-18 {w}"), ("vitamin C {w}", "vitamin C. {w}")]
    ),
    "acronyms_exploded_cases": of_text(
        acronyms_exploded, [("the P.C.A. {w}", "the P. C. A. {w}"), ("{w} A.330 jet", "{w} A. double three zero jet"), ("R.&D. {w}", "R. AND D. {w}")]
    ),
    "acronyms_exploded_fr_cases": of_text(
        lambda t: acronyms_exploded(t, "fr"), [("le P.C.A. {w}", "le P. C. A. {w}"), ("{w} A.330 vole", "{w} A. deux trois zéro vole"), ("R.&D. {w}", "R. ET D. {w}")]
    ),
    "acronyms_readable_cases": of_text(
        acronyms_exploded_unless_readable, [("the N.A.T.O. {w}", "the NATO {w}"), ("{w} J.P.E.G. file", "{w} J. PEG file"), ("F.B.I. {w}", "F. B. I. {w}"), ("M.P.E.G.4 {w}", "M. PEG four {w}")]
    ),
    "roman_numbers_en_cases": of_text(
        lambda t: english.roman_numbers(t, ENGLISH), [("Louis XIV {w}", "Louis the 14th {w}"), ("volume XIII {w}", "volume 13 {w}"), ("{w} in MMXX .", "{w} in 2020 .")]
    ),
    "roman_numbers_fr_cases": of_text(lambda t: french.roman_numbers(t, FRENCH), [("Louis XIV {w}", "Louis 14e {w}"), ("tome XIII {w}", "tome 13 {w}"), ("XII", "12")]),
    "leftovers_en_cases": of_text(
        english.end,
        [("{w} b 12 end", "{w} B. twelve end"), ("Smith + Jones {w} & co", "Smith and Jones {w} and co"), ("the .html {w}", "the dot html {w}"), ("{w} - off", "{w} off"), ("{w}# B", "{w} B.")],
    ),
    "leftovers_fr_cases": of_text(
        french.end,
        [("l' image d' un {w}", "l' image d' un {w}"), ("{w} y va b 12", "{w} y va B. douze"), ("c' est l' heure ( {w} )", "c' est l' heure {w}"), ("{w} & fils", "{w} et fils")],
    ),
    "rules_spelling_cases": of_text(
        rules.built_in(rules.UK_TO_US).apply, [("the colour of {w}", "the color of {w}"), ("{w} theatre's end", "{w} theater's end"), ("discoloured {w}", "discoloured {w}")]
    ),
    "rules_kept_cases": of_text(rules.RuleSet(rules.parse([r"[a-zA-Z]\K\+ =>  plus", "new york => New York"])).apply, [("{w} a+ b", "{w} a plus b"), ("in new york {w}", "in New York {w}")]),
    "time_seconds_cases": of_text(
        english.date_and_time,
        [("at 3:45:20 pm {w}", "at <TIME> three forty-five and twenty in the afternoon </TIME> {w}"), ("{w} at 9:15 am", "{w} at <TIME> quarter past nine in the morning </TIME>")],
    ),
    "time_fr_cases": of_text(
        french.date_and_time, [("à 8h40 {w}", "à <TIME> neuf heures moins vingt </TIME> {w}"), ("{w} à 10h30", "{w} à <TIME> dix heures et demie </TIME>"), ("à 12h {w}", "à <TIME> midi </TIME> {w}")]
    ),
    "decades_cases": of_text(english.date_and_time, [("in the 1990s {w}", "in the <DATE> nineties </DATE> {w}"), ("since May 2004 {w}", "since <DATE> May two thousand four </DATE> {w}")]),
    "generic_en_cases": of_frame(
        normalise.generic,
        [
            ("The {w} costs $5 million.", "the {w} costs <CURRENCY> five million dollars </CURRENCY> ."),
            ("Dr. Smith's 3 {w} boxes weigh 20kg.", "Doctor Smith's three {w} boxes weigh <QUANTITY> twenty kilograms </QUANTITY> ."),
            ("It's the 21st {w}, isn't it?", "it's the twenty-first {w} isn't it ?"),
        ],
    ),
    "generic_fr_cases": of_frame(
        lambda df: normalise.generic(df, lang="fr"),
        [
            ("L'équipe d'analyse du {w} travaille.", "l' équipe d' analyse du {w} travaille ."),
            ("Au XXIe siècle, il y a dix {w}.", "Au vingt et unième siècle , il y a dix {w} ."),
            ("Il part en octobre 2005 avec ses 30 {w}.", "il part en <DATE> octobre deux mille cinq </DATE> avec ses trente {w} ."),
        ],
    ),
    "preset_asr_cases": _preset("asr", "en", [("The N.A.T.O. group, in 1995.", "THE NATO GROUP IN NINETEEN NINETY FIVE"), ("He paid $3 for it.", "HE PAID THREE DOLLARS FOR IT")]),
    "preset_tts_cases": _preset("tts", "en", [("He paid $3. She left.", "HE PAID THREE DOLLARS .\nSHE LEFT .")]),
    "preset_g2p_cases": _preset("g2p", "en", [("The F.B.I. paid $3 to {w}.", "the f. b. i. paid three dollars to {w} .")]),
    "preset_indexing_cases": _preset("indexing", "en", [("The F.B.I. paid $3.", "THE F.B.I. PAID THREE DOLLARS")]),
    "preset_nlp_cases": _preset("nlp", "en", [("The F.B.I. paid $3 for {w}.", "the F.B.I. paid three dollars for {w} .")]),
    "preset_asr_fr_cases": _preset("asr", "fr", [("L'I.R.I.S.A. et le M.P.E.G.4 d'hier.", "L' IRISA ET LE M. PEG QUATRE D' HIER")]),
    "speech_en_cases": of_frame(normalise.speech_text, [("The {w} costs $5 . It is here .", "the {w} costs five dollars .\nit is here .\n")]),
    "speech_fr_cases": of_frame(lambda df: normalise.speech_text(df, lang="fr"), _SPEECH_FR),
    "speech_paragraphs_cases": of_frame(lambda df: normalise.speech_text(df, keep_paragraphs=True), [("The {w} costs $5 . It is here .", "the {w} costs five dollars . it is here .\n")]),
    "final_cases": of_text(specific.final, [("{w} has 12 parts", "{w} has twelve parts"), ("plan b. of {w}", "plan B. of {w}"), ("plan c for a {w}", "plan C. for a {w}"), ("{w} B and I", "{w} B. and I")]),
    "blank_lines_cases": of_frame(
        lambda df: df.withColumn("text", columns.single_blank_lines(F.col("text"))), [("{w}\n\n\n\nb\nc\n\nd", "{w}\n\nb\nc\n\nd"), ("\n\n{w}\n\n", "\n{w}\n"), ("{w}\nb", "{w}\nb")]
    ),
    "named_rules_cases": of_text(
        lambda t: BOOK.apply(t, "spelling", "unknown", "abbreviations"), [("the colour of {w} etc.", "the color of {w} et cetera"), ("{w} grey", "{w} gray")]
    ),
    "chained_steps_cases": of_text(chain(english.remove_bugs, english.process_ing, english.process_d), [("goin' & ask'd {w}", "going and asked {w}")]),
}
