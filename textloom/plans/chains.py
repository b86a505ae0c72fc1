"""Queries of steps that need a lexicon, of whole chains, streams and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleaning, english, french
from textloom.functions.arrow import text_function
from textloom.functions.lexicon import ENGLISH, FRENCH, PLACES
from textloom.operators import rules
from textloom.operators.specific import acronyms_exploded, acronyms_exploded_unless_readable, specific
from textloom.plans import normalise, sql
from textloom.plans.catalog import Query, table
from textloom.session import shared_path, spread
from textloom.sources import resources, ssml
from textloom.streaming import normalise as streams


def _step(step: Callable[[str], str], lang: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A text step over the documents, of one language or of all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
        docs = docs if lang is None else docs.where(F.col("lang") == lang)
        return docs.select("doc_id", text_function(step)("text").alias("text"))

    return run


def _chain(step: Callable[[DataFrame], DataFrame], lang: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).where(F.col("lang") == lang)).select("doc_id", "text")


def _preset(name: str, lang: str = "en") -> Query:
    return Query(_chain(lambda d: normalise.normalised(d, name, lang=lang), lang))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the pages in words."""
    return table(spark, sf_dir, "pages").select("page_id", text_function(english.url)(F.concat(F.lit("see "), "url")).alias("text"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lower("p_name"), F.lit(" macdonald"))
    return table(spark, sf_dir, "part").select("p_partkey", text_function(cleaning.name_case)(text).alias("text"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places, listed ones parted."""
    places = F.array(*[F.lit(p) for p in (*PLACES, "Springfield")])

    def place(k: int):
        return F.get(places, ((F.col("o_custkey") * k + F.col("o_orderkey")) % len([*PLACES, ""])).cast("int"))

    text = F.concat(F.lit("from "), place(1), F.lit("-"), place(3), F.lit(" by rail"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text_function(lambda t: cleaning.split_entities(t, PLACES))(text).alias("text"))


_PLACES = "[" + ", ".join(f"'{p}'" for p in (*PLACES, "Springfield")) + "]"


def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French words without their accents, restored by the lexicon of all French words.

    Words meet their accented forms by a join on the plain form; the fewest
    changes win, and a draw leaves the word.
    """
    docs = table(spark, sf_dir, "documents").where("lang = 'fr'")
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return accent_join(found, found)


_ACCENTS = ("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")


def accent_join(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, restored: for every word written plain, its form in the lexicon (word)."""
    plain = words.select(F.translate("word", *_ACCENTS).alias("plain")).distinct()
    forms = lexicon.select("word", F.translate("word", *_ACCENTS).alias("plain"))
    changed = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.lit(0), lambda n, i: n + (F.col("word").substr(i, F.lit(1)) != F.col("plain").substr(i, F.lit(1))).cast("int"))
    scored = plain.join(forms, "plain").select("plain", "word", changed.alias("d"))
    best = scored.groupBy("plain").agg(F.min("d").alias("d"))
    top = scored.join(best, ["plain", "d"]).groupBy("plain", "d").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("n"))
    return top.select(F.col("plain").alias("word"), F.when(F.col("n") > 1, F.col("plain")).otherwise(F.col("word")).alias("restored"))


_DIFFERENT = "list_sum(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN word[i] <> plain[i] THEN 1 ELSE 0 END))"
_ACCENT_SQL = f"""WITH w AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents WHERE lang = 'fr') WHERE w <> ''),
f AS (SELECT word, translate(word, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS plain FROM w),
s AS (SELECT plain, word, {_DIFFERENT} AS d FROM f), b AS (SELECT plain, min(d) AS d FROM s GROUP BY plain)
SELECT s.plain AS word, CASE WHEN count(*) > 1 THEN s.plain ELSE min(s.word) END AS restored FROM s JOIN b ON b.plain = s.plain AND b.d = s.d GROUP BY s.plain"""


_GERMAN = (("ä", "ae"), ("ñ", "ny"), ("ö", "oe"), ("ü", "ue"), ("ÿ", "yu"))
_LIGATURES = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "Oe"), ("œ", "oe"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("’", "'"))
_ING = (
    r"array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN regexp_full_match(w, '(?i)\p{L}+in''') THEN w[:-2] || 'g' "
    r"WHEN regexp_full_match(w, '(?i)\p{L}+''ing') THEN replace(w, '''', '') ELSE w END), ' ')"
)


def _folded(x: str) -> str:
    return f"translate({sql.swap(x, *_LIGATURES)}, 'ÐĐðđĦħıĸĿŁŀłŊŉŋØøſÞŦþŧəƏ', 'DDddHhikLLllNnnOosTTttee')"


def ssml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterance items of SSML made from customers."""
    xml = F.concat(F.lit("<speak><s>Dear <sub alias='"), F.lower("c_mktsegment"), F.lit("'>seg</sub> friend</s><s>pay <break time='250ms'/> "), F.col("c_nationkey").cast("string"), F.lit("</s></speak>"))
    docs = table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"))
    return ssml.read_ssml(docs, "c_custkey", "xml").select("doc_id", "utterance", "sequence", "item", "value")


_SSML_SQL = """SELECT c_custkey AS doc_id, CAST(u AS INTEGER) AS utterance, s AS sequence, CAST(i AS INTEGER) AS item, v AS value FROM (
SELECT c_custkey, unnest([0, 0, 0, 1, 1, 1, 1]) AS u, unnest(['word', 'word', 'word', 'word', 'word', 'filler', 'duration']) AS s,
unnest([0, 1, 2, 0, 1, 0, 0]) AS i, unnest(['Dear', lower(c_mktsegment), 'friend', 'pay', CAST(c_nationkey AS VARCHAR), 'silence', '0.25']) AS v FROM customer)"""


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as a stream, trimmed and written exactly once."""
    from textloom.operators import columns

    docs = table(spark, sf_dir, "documents")
    source = streams.read_stream(spark, f"{sf_dir}/documents.parque[t]", docs.schema.simpleString()[7:-1].replace(":", " "))
    out, state = shared_path(spark), shared_path(spark)
    streams.normalise_stream(source.select("doc_id", columns.trim_blanks(F.col("text")).alias("text")), lambda d: d, out, state).awaitTermination()
    return spark.read.parquet(out)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark written as text files and read back."""
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    path = shared_path(spark)
    resources.write_texts(lines, "line", path)
    return resources.read_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written tab-separated and loaded with a least count."""
    from textloom.plans.vocabularies import counts

    path = shared_path(spark)
    resources.write_texts(counts(spark, sf_dir).select(F.concat_ws("\t", "ngram", "c").alias("line")), "line", path)
    return resources.read_counts(spark, path, min_count=2)


QUERIES = {
    "tokenise_en": Query(_chain(normalise.tokenised, "en")),
    "tokenise_fr": Query(_chain(lambda d: normalise.tokenised(d, lang="fr"), "fr")),
    "remove_bugs_en": Query(_step(english.remove_bugs, "en")),
    "remove_bugs_fr": Query(_step(french.remove_bugs, "fr")),
    "process_ing": Query(_step(english.process_ing, "en"), sql.documents(sql.by_line("text", _ING)) + " WHERE lang = 'en'"),
    "process_d": Query(_step(english.process_d, "en")),
    "compact_initials": Query(_step(lambda t: cleaning.initials(t, ENGLISH), "en")),
    "compact_acronyms": Query(_step(cleaning.compact_acronyms)),
    "diacritics_en": Query(_step(cleaning.strip_diacritics), sql.documents(_folded(f"strip_accents({sql.swap('text', *_GERMAN)})"))),
    "diacritics_fr": Query(_step(cleaning.fold_letters, "fr"), sql.documents(_folded("text")) + " WHERE lang = 'fr'"),
    "first_letter_en": Query(_step(lambda t: cleaning.first_letters(t, ENGLISH), "en")),
    "first_letter_fr": Query(_step(lambda t: cleaning.first_letters(t, FRENCH, elision=True), "fr")),
    "complex_abbreviations_en": Query(_step(english.complex_abbreviations, "en")),
    "complex_abbreviations_fr": Query(_step(french.complex_abbreviations, "fr")),
    "url_spelled": Query(page_urls),
    "split_entities": Query(
        entities,
        f"""SELECT o_orderkey, 'from ' || a || CASE WHEN a = 'Springfield' OR b = 'Springfield' THEN '-' ELSE ' ' END || b || ' by rail' AS text
FROM (SELECT o_orderkey, {_PLACES}[(o_custkey + o_orderkey) % 11 + 1] AS a, {_PLACES}[(o_custkey * 3 + o_orderkey) % 11 + 1] AS b FROM orders)""",
    ),
    "entity_fixes": Query(_step(cleaning.entity_fixes)),
    "bad_tags": Query(_step(cleaning.drop_bad_tags)),
    "hyphenate_en": Query(_step(lambda t: english.hyphenate(t, ENGLISH), "en")),
    "hyphenate_fr": Query(_step(lambda t: french.hyphenate(t, FRENCH), "fr")),
    "apostrophes_en": Query(_step(lambda t: english.apostrophes(t, ENGLISH), "en")),
    "apostrophes_fr": Query(_step(lambda t: french.apostrophes(t, FRENCH), "fr")),
    "acronyms_dotted": Query(_step(lambda t: cleaning.acronyms(t, ENGLISH), "en")),
    "acronyms_exploded": Query(_step(acronyms_exploded)),
    "acronyms_exploded_unless_readable": Query(_step(acronyms_exploded_unless_readable)),
    "roman_numbers_en": Query(_step(lambda t: english.roman_numbers(t, ENGLISH), "en")),
    "roman_numbers_fr": Query(_step(lambda t: french.roman_numbers(t, FRENCH), "fr")),
    "leftovers_en": Query(_step(english.end, "en")),
    "leftovers_fr": Query(_step(french.end, "fr")),
    "weak_punctuation_drop": Query(
        _step(english.drop_weak_punctuation), sql.documents(sql.trim(sql.rr("text", ("[,;:()¡¿]", " "))))
    ),
    "name_case": Query(
        names,
        "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[:1]) || w[2:]), ' ') || ' MacDonald' AS text FROM part",
    ),
    "accent_restoration": Query(accents, _ACCENT_SQL),
    "rules_spelling": Query(lambda spark, sf_dir: rules.apply_rules(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", rules.built_in(rules.UK_TO_US), rules.built_in(rules.HESITATIONS))),
    "generic_en": Query(_chain(normalise.generic, "en")),
    "generic_fr": Query(_chain(lambda d: normalise.generic(d, lang="fr"), "fr")),
    "preset_asr": _preset("asr"),
    "preset_tts": _preset("tts"),
    "preset_g2p": _preset("g2p"),
    "preset_indexing": _preset("indexing"),
    "preset_nlp": _preset("nlp"),
    "preset_asr_fr": _preset("asr", "fr"),
    "speech_en": Query(_chain(normalise.speech_text, "en")),
    "speech_fr": Query(_chain(lambda d: normalise.speech_text(d, lang="fr"), "fr")),
    "specific_options": Query(
        lambda spark, sf_dir: specific(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["HYPHENS_OFF", "CASE_OFF"]),
        sql.documents(sql.trim(f"upper({sql.swap('text', ('-', ' '), ('ß', 'SS'))})")),
    ),
    "ssml_items": Query(ssml_items, _SSML_SQL),
    "stream_trimmed": Query(streamed, sql.documents(sql.trim("text"))),
    "text_round_trip": Query(round_trip, "SELECT l AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) GROUP BY l"),
    "count_files": Query(
        count_files, "WITH " + sql.COUNTS + "SELECT ngram, c FROM counts WHERE len(string_split(ngram, ' ')) = 2 OR len(string_split(ngram, ' ')) = 1 AND c >= 2"
    ),
}
