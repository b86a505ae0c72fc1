"""Queries of the rewrites that are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import columns
from textloom.plans import sql
from textloom.plans.catalog import Query, table
from textloom.session import spread

WEAK = r'[,;:"()¡¿]'
STRONG = r"(?:\.\.\.|[?!_.])"
MARK = r'(?:\.\.\.|[¡¿,;:"()?!_.])'


def _documents(step: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", step(F.col("text")).alias("text"))


def _dropped(mark: str) -> str:
    """A line without the tokens that are marks; a line that is one token stays."""
    words = f"list_filter(string_split(l, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, {sql.quote(mark)}))"
    return sql.by_line("text", f"CASE WHEN len(string_split(l, ' ')) = 1 THEN l ELSE array_to_string({words}, ' ') END")


def _broken() -> str:
    doubled = sql.rr(sql.swap("text", (" ", "  ")), (f" ({STRONG}) ", " \\1\n"))
    alone = sql.rr(sql.swap(sql.rr(doubled, ("(?m)^ +", "")), ("  ", " ")), *[(rf"({STRONG})\n({STRONG})", r"\1 \2")] * 2)
    return sql.trim(alone)


#: Tagged sentences from order columns, and the same by SQL.
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("long").cast("string")
    text = F.concat(F.lit("on <DATE> "), day, F.lit(" </DATE> for <CURRENCY> "), price, F.lit(" euros </CURRENCY> 's sake"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), day.alias("day"), price.alias("price"))


_ORDER = "FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders)"


def _tagged(step: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tagged(spark, sf_dir).select("o_orderkey", step(F.col("text")).alias("text"))


def tag_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("o_orderkey", F.explode(columns.tag_bodies(F.col("text"))).alias("x")).select("o_orderkey", "x.tag", "x.body")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sentence, numbered."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(columns.sentences(F.col("text"))).alias("sentence", "text"))


def thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.format_number((F.col("o_totalprice") * 100).cast("long") * 10, 0)
    text = F.concat(F.lit("all "), cents, F.lit(", then 1,23 and 4,5678 of "), cents)
    return table(spark, sf_dir, "orders").select("o_orderkey", columns.thousand_separators(text).alias("text"))


_CENTS = "CAST(CAST(trunc(o_totalprice * 100) AS BIGINT) * 10 AS VARCHAR)"


def pronounceable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, in capitals, with whether it reads as a word."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w"))
    names = words.where("w <> ''").select(F.upper("w").alias("word")).distinct()
    return names.select("word", columns.pronounceable(F.col("word")).alias("readable"))


_READABLE = (
    "(?:(?:[BFP][LR]|[CGK][LRW]|[DT][RW]|S(?:CH|H|K[RW]?|L|M|N|P[LR]?|W)|CH|[B-DF-HJ-NP-TV-XZ])?[AEIOUY]{1,2})+"
    "(?:[CFKP]T|L(?:CH|[BDJKMPT])|M[FP]|N[DT]|PS|S[KPT]|[B-DF-HJ-NP-TV-XZ])?"
)
_GERMAN = (("ä", "ae"), ("ñ", "ny"), ("ö", "oe"), ("ü", "ue"), ("ÿ", "yu"))
_LIGATURES = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "Oe"), ("œ", "oe"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("…", "..."))
_GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("Δ", "delta"), ("μ", "micro"), ("ρ", "rho"), ("λ", "lambda"), ("Λ", "lambda"))
_GAP = r"(?:[ \n]|$)"
_PDF = ((rf"(?m)^(?:\d\.)+{_GAP}", ""), (rf"(?m)^\w\.{_GAP}", ""), (rf"(?m)^\(?[i\d]+\)?{_GAP}", ""), ("(?m)^ +o +", ""))
_LETTER = r"[\p{L}\p{N}_]"
_SPACE = (
    ("([,;:¡¿()]) ", r" \1 "),
    *[("([a-z]) - ([a-zA-Z])", "\\1\n\\2")] * 2,
    (r" \(", " ( "),
    (rf'({_LETTER})([«»"])', r"\1 \2 "),
    (rf'([«»"])(\n|{_LETTER})', r" \1 \2"),
)
_WIDE = (r"\?( [0-9A-Z])", "\x01\\1")

QUERIES = {
    "trim_blanks": Query(_documents(columns.trim_blanks), sql.documents(sql.trim("text"))),
    "punctuation_off": Query(_documents(columns.punctuation_off), sql.documents(_dropped(MARK))),
    "weak_punctuation_off": Query(_documents(columns.weak_punctuation_off), sql.documents(_dropped(WEAK))),
    "break_lines": Query(_documents(columns.break_lines), sql.documents(_broken())),
    "sentences": Query(
        sentences,
        f"SELECT doc_id, i - 1 AS sentence, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split({_broken()}, chr(10)) AS ls FROM documents))",
    ),
    "hyphens_off": Query(_documents(columns.hyphens_off), sql.documents(sql.swap("text", ("-", " ")))),
    "hyphens_internal": Query(_documents(columns.hyphens_internal), sql.documents(sql.rr("text", ("(?m)(^| )-", r"\1"), ("(?m)-( |\n|$)", r"\1")))),
    "saxon_exploded": Query(
        _documents(columns.saxon_exploded),
        sql.documents(sql.rr("text", ("(?mi)'s( |\n|$)", r" 's\1"), ("(?mi)(s)'( |\n|$)", r"\1 's\2"))),
    ),
    "saxon_joint": Query(_documents(columns.saxon_joint), sql.documents(sql.swap("text", (" 's", "'s")))),
    "tags_off": Query(_tagged(columns.tags_off), f"SELECT o_orderkey, 'on ' || day || ' for ' || price || ' euros''s sake' AS text {_ORDER}"),
    "tag_off": Query(
        _tagged(lambda c: columns.tag_off(c, "DATE")),
        f"SELECT o_orderkey, 'on ' || day || ' for <CURRENCY> ' || price || ' euros </CURRENCY>''s sake' AS text {_ORDER}",
    ),
    "tags_on": Query(_tagged(columns.tags_on), f"SELECT o_orderkey, 'on <DATE> for <CURRENCY> ''s sake' AS text {_ORDER}"),
    "tag_bodies": Query(
        tag_bodies,
        f"SELECT o_orderkey, 'DATE' AS tag, day AS body {_ORDER} UNION ALL SELECT o_orderkey, 'CURRENCY', price || ' euros' {_ORDER}",
    ),
    "letter_dots_off": Query(
        _documents(columns.letter_dots_off),
        sql.documents(sql.by_line("text", "array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN regexp_full_match(w, '[^.]\\.') THEN w[:1] ELSE w END), ' ')")),
    ),
    "acronyms_joint": Query(
        _documents(columns.acronyms_joint),
        sql.documents(sql.rr("text", *[(r"([A-Z])\.(-?[A-Z])", r"\1\2")] * 2, (r"([A-Z]{2})\.([^A-Z]|$)", r"\1\2"))),
    ),
    "case_off": Query(_documents(columns.case_off), sql.documents(f"upper({sql.swap('text', ('ß', 'SS'))})")),
    "case_low": Query(_documents(columns.case_low), sql.documents("lower(text)")),
    "thousand_separators": Query(thousands, f"SELECT o_orderkey, 'all ' || {_CENTS} || ', then 1,23 and 4,5678 of ' || {_CENTS} AS text FROM orders"),
    "latin_fold": Query(
        _documents(columns.latin_fold),
        sql.documents(f"translate({sql.swap('text', *_GERMAN, *_LIGATURES)}, 'ÐĐðđĦħıĸĿŁŀłŊŉŋØøſÞŦþŧəƏ’', 'DDddHhikLLllNnnOosTTttee''')"),
    ),
    "greek_names": Query(_documents(columns.greek_names), sql.documents(sql.swap("text", *_GREEK))),
    "triple_letters": Query(_documents(columns.triple_letters)),
    "clean_pdf": Query(_documents(columns.clean_pdf), sql.documents(sql.rr("text", *_PDF, *_PDF))),
    "clean_wide": Query(
        _documents(columns.clean_wide),
        sql.documents(sql.trim(sql.swap(sql.rr(sql.swap(sql.rr("text", _WIDE), ("?", " "), ("\x01", "?")), (r"([,;\-.?!])\?", r"\1 ")), ("\x01", "?")))),
    ),
    "space_punctuation": Query(_documents(columns.space_punctuation), sql.documents(sql.trim(sql.rr("text", *_SPACE)))),
    "pronounceable_acronym": Query(
        pronounceable,
        "SELECT word, length(word) BETWEEN 3 AND 6 AND regexp_full_match(word, " + sql.quote(_READABLE) + ") AS readable "
        "FROM (SELECT DISTINCT upper(w) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents) WHERE w <> '')",
    ),
}
