"""Queries of numbers, dates, times, money, units and telephone numbers in words.

Sentences are made from columns, normalised, and compared with words that SQL
makes from the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleaning, english, french, numbers_en, numbers_fr, roman
from textloom.functions.arrow import text_function
from textloom.functions.lexicon import ENGLISH, FRENCH
from textloom.plans.catalog import Query, table


def _said(name: str, key: str, value: Callable[[], Column], step: Callable[[str], str | None]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(key, text_function(step)(value().cast("string")).alias("text"))

    return run


_CENTS = "CAST(trunc(o_totalprice * 100) AS BIGINT)"
_EN = """
en AS (SELECT n, CASE WHEN n < 20 THEN u[n + 1] ELSE t[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || u[n % 10 + 1] ELSE '' END END AS w
  FROM (SELECT unnest(range(100)) AS n, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen',
  'fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS u, ['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t)),
en3 AS (SELECT h.n AS n, CASE WHEN h.n < 100 THEN lo.w ELSE hi.w || ' hundred' || CASE WHEN h.n % 100 > 0 THEN ' and ' || lo.w ELSE '' END END AS w
  FROM (SELECT unnest(range(1000)) AS n) h JOIN en lo ON lo.n = h.n % 100 JOIN en hi ON hi.n = h.n // 100)
"""
_FR = """
fr AS (SELECT n, CASE WHEN n < 20 THEN u[n + 1] WHEN n = 80 THEN 'quatre-vingts' WHEN n % 10 = 0 AND n NOT IN (70, 90) THEN t[n // 10 - 1]
  WHEN n IN (21, 31, 41, 51, 61) THEN t[n // 10 - 1] || ' et un' WHEN n = 71 THEN 'soixante et onze'
  WHEN n // 10 IN (7, 9) THEN t[n // 10 - 1] || '-' || u[n % 10 + 11] ELSE t[n // 10 - 1] || '-' || u[n % 10 + 1] END AS w
  FROM (SELECT unnest(range(100)) AS n, ['zéro','un','deux','trois','quatre','cinq','six','sept','huit','neuf','dix','onze','douze','treize','quatorze',
  'quinze','seize','dix-sept','dix-huit','dix-neuf'] AS u, ['vingt','trente','quarante','cinquante','soixante','soixante','quatre-vingt','quatre-vingt'] AS t)),
fr3 AS (SELECT h.n AS n, CASE WHEN h.n < 100 THEN lo.w ELSE CASE WHEN h.n >= 200 THEN hi.w || ' ' ELSE '' END || 'cent' ||
  CASE WHEN h.n % 100 > 0 THEN ' ' || lo.w ELSE '' END END AS inner_, CASE WHEN h.n >= 200 AND h.n % 100 = 0 THEN 's' ELSE '' END AS s
  FROM (SELECT unnest(range(1000)) AS n) h JOIN fr lo ON lo.n = h.n % 100 JOIN fr hi ON hi.n = h.n // 100)
"""
#: A cardinal below a thousand million, from its groups of three digits.
_EN_NUMBER = f"""WITH {_EN}, x AS (SELECT o_orderkey, {_CENTS} AS v FROM orders),
g AS (SELECT o_orderkey, v, list_filter([CASE WHEN v >= 1000000 THEN c.w || ' million' END, CASE WHEN v // 1000 % 1000 > 0 THEN b.w || ' thousand' END,
  CASE WHEN v % 1000 > 0 OR v = 0 THEN a.w END], lambda w: w IS NOT NULL) AS p
  FROM x JOIN en3 a ON a.n = v % 1000 JOIN en3 b ON b.n = v // 1000 % 1000 JOIN en3 c ON c.n = v // 1000000),
cardinal AS (SELECT o_orderkey, CASE WHEN v % 1000 BETWEEN 1 AND 99 AND len(p) = 2 THEN p[1] || ' and ' || p[2]
  WHEN v % 1000 BETWEEN 1 AND 99 AND len(p) > 2 THEN array_to_string(p[:-2], ', ') || ' and, ' || p[-1]
  WHEN len(p) = 2 THEN p[1] || ' ' || p[2] ELSE array_to_string(p, ', ') END AS text FROM g)
"""
_FR_NUMBER = f"""WITH {_FR}, x AS (SELECT o_orderkey, {_CENTS} AS v FROM orders),
cardinal AS (SELECT o_orderkey, CASE WHEN v = 0 THEN 'zéro' ELSE array_to_string(list_filter([
  CASE WHEN v >= 2000000 THEN c.inner_ || ' millions' WHEN v >= 1000000 THEN 'un million' END,
  CASE WHEN v // 1000 % 1000 = 1 THEN 'mille' WHEN v // 1000 % 1000 > 1 THEN b.inner_ || ' mille' END,
  CASE WHEN v % 1000 > 0 THEN a.inner_ || a.s END], lambda w: w IS NOT NULL), ' ') END AS text
  FROM x JOIN fr3 a ON a.n = v % 1000 JOIN fr3 b ON b.n = v // 1000 % 1000 JOIN fr3 c ON c.n = v // 1000000)
"""
_EN_LAST = "regexp_extract(text, '(\\w+)$', 1)"
_EN_ORDINAL = f"""SELECT o_orderkey, text[:length(text) - length({_EN_LAST})] || CASE {_EN_LAST} WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third'
  WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth' WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth'
  ELSE CASE WHEN text LIKE '%y' THEN {_EN_LAST}[:-2] || 'ieth' ELSE {_EN_LAST} || 'th' END END AS text FROM cardinal"""
_FR_ORDINAL = """SELECT o_orderkey, CASE WHEN text = 'un' THEN 'premier' WHEN text LIKE '%cinq' THEN text || 'uième' WHEN text LIKE '%neuf' THEN text[:-2] || 'vième'
  WHEN text LIKE '%e' THEN text[:-2] || 'ième' WHEN text LIKE '%vingts' OR text LIKE '%cents' THEN text[:-2] || 'ième' ELSE text || 'ième' END AS text FROM cardinal"""
_ROMAN = """SELECT p_partkey, repeat('M', n // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] ||
  ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] AS text
  FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)"""
_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_MOIS = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"
_NTH = """nth AS (SELECT n, CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' WHEN 5 THEN 'fifth' WHEN 8 THEN 'eighth' WHEN 9 THEN 'ninth' WHEN 12 THEN 'twelfth'
  WHEN 20 THEN 'twentieth' WHEN 21 THEN 'twenty-first' WHEN 22 THEN 'twenty-second' WHEN 23 THEN 'twenty-third' WHEN 25 THEN 'twenty-fifth' WHEN 28 THEN 'twenty-eighth'
  WHEN 29 THEN 'twenty-ninth' WHEN 30 THEN 'thirtieth' WHEN 31 THEN 'thirty-first' ELSE w || 'th' END AS w FROM en)"""
_YEAR = "CASE WHEN y = 2000 THEN 'two thousand' WHEN y > 2000 THEN 'two thousand ' || yl.w ELSE yh.w || CASE WHEN y % 100 = 0 THEN ' hundred' WHEN y % 100 < 10 THEN ' zero ' || yl.w ELSE ' ' || yl.w END END"
_DATE_PARTS = "SELECT o_orderkey, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders"
_DATE_EN = f"""WITH {_EN}, {_NTH}, x AS ({_DATE_PARTS}) SELECT o_orderkey, 'sent <DATE> the ' || nth.w || ' of ' || {_MONTHS}[m] || ' ' || {_YEAR} || ' </DATE> by us' AS text
  FROM x JOIN nth ON nth.n = d JOIN en yh ON yh.n = y // 100 JOIN en yl ON yl.n = y % 100"""
_YEAR_EN = f"""WITH {_EN}, x AS (SELECT o_orderkey, 1300 + o_orderkey % 800 AS y FROM orders) SELECT o_orderkey, {_YEAR} AS text
  FROM x JOIN en yh ON yh.n = y // 100 JOIN en yl ON yl.n = y % 100"""
_TIME_EN = f"""WITH {_EN}, x AS (SELECT event_id, hour(ts) AS h, minute(ts) // 5 * 5 AS m FROM events) SELECT event_id, 'at <TIME> ' || CASE
  WHEN m = 0 AND h = 12 THEN 'noon' WHEN m = 0 THEN a.w || ' o''clock' WHEN m = 15 THEN 'quarter past ' || a.w WHEN m = 30 THEN 'half past ' || a.w
  WHEN m = 45 THEN 'quarter to ' || b.w WHEN m > 30 THEN c.w || ' to ' || b.w ELSE c.w || ' past ' || a.w END || ' </TIME> they came' AS text
  FROM x JOIN en a ON a.n = h JOIN en b ON b.n = (h + 1) % 12 JOIN en c ON c.n = CASE WHEN m > 30 THEN 60 - m ELSE m END"""
_MONEY = "SELECT o_orderkey, 'paid <CURRENCY> ' || n || CASE WHEN n < 2 THEN ' dollar' ELSE ' dollars' END || ' </CURRENCY> today' AS text FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders)"
_MONEY_FR = "SELECT o_orderkey, 'payé <CURRENCY> ' || n || CASE WHEN n < 2 THEN ' euro' ELSE ' euros' END || ' </CURRENCY> hier' AS text FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders)"
_SIZE = "SELECT p_partkey, 'about <QUANTITY> ' || p_size || CASE WHEN p_size < 2 THEN ' {0}' ELSE ' {0}s' END || ' </QUANTITY> {1}' AS text FROM part"




def day(pattern: str, before: str, after: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.date_format("o_orderdate", pattern), F.lit(after))


def jour() -> Column:
    months = F.array(*[F.lit(m) for m in french.MONTHS])
    return F.concat_ws(" ", F.lit("envoyé"), F.dayofmonth("o_orderdate"), F.get(months, F.month("o_orderdate") - 1), F.year("o_orderdate"), F.lit("par nous"))


def clock() -> Column:
    five = F.floor(F.minute("ts") / 5) * 5
    return F.format_string("at %02d:%02d they came", F.hour("ts").cast("int"), five.cast("int"))


def amount(before: str, after: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.col("o_totalprice").cast("long").cast("string"), F.lit(after))


def size(before: str, after: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.col("p_size").cast("string"), F.lit(after))


def cents() -> Column:
    return (F.col("o_totalprice") * 100).cast("long")


def year() -> Column:
    return 1300 + F.col("o_orderkey") % 800


def phone() -> Column:
    return F.format_string("call 0%d-%03d-%04d now", (F.col("c_custkey") % 9).cast("int"), (F.col("c_custkey") * 7 % 1000).cast("int"), (F.col("c_custkey") * 31 % 10000).cast("int"))


def span() -> Column:
    return F.format_string("for %d h %d min only", (F.col("l_partkey") % 20 + 1).cast("int"), F.col("l_quantity").cast("int"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text_function(english.durations)(span()).alias("text"))


def fractions() -> Column:
    return F.format_string("about %d/%d of it", (F.col("p_partkey") % 9 + 1).cast("int"), (F.col("p_size") % 9 + 5).cast("int"))


def comparisons() -> Column:
    return F.format_string("it <= %d but > %d", F.col("p_size"), (F.col("p_partkey") % 90).cast("int"))


def roman_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 3999 + 1).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", text_function(lambda t: roman.from_int(int(t)))(n).alias("text"))


def roman_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    numerals = roman_text(spark, sf_dir)
    return numerals.select("p_partkey", text_function(lambda t: roman.decimal(t, True))("text").alias("text"))


_PHONE_DIGITS = "printf('0%d%03d%04d', c_custkey % 9, c_custkey * 7 % 1000, c_custkey * 31 % 10000)"
_FRACTION = f"""WITH {_EN}, x AS (SELECT p_partkey, p_partkey % 9 + 1 AS a, p_size % 9 + 5 AS b FROM part) SELECT p_partkey, 'about ' ||
  CASE WHEN b < 10 THEN en.w || ' out of ' || d.w ELSE en.w || ' ' || CASE WHEN b = 12 THEN 'twelfth' ELSE d.w || 'th' END || CASE WHEN a > 1 THEN 's' ELSE '' END END || ' of it' AS text
  FROM x JOIN en ON en.n = a JOIN en d ON d.n = b"""
_COMPARE = f"""WITH {_EN} SELECT p_partkey, 'it is lower than or equal to ' || a.w || ' but is greater than ' || b.w AS text
  FROM part JOIN en a ON a.n = p_size JOIN en b ON b.n = p_partkey % 90"""
_SPAN = """SELECT l_orderkey, l_linenumber, 'for ' || h || CASE WHEN h = 1 THEN ' hour ' ELSE ' hours ' END || m || CASE WHEN m = 1 THEN ' minute' ELSE ' minutes' END || ' only' AS text
  FROM (SELECT l_orderkey, l_linenumber, l_partkey % 20 + 1 AS h, CAST(trunc(l_quantity) AS BIGINT) AS m FROM lineitem)"""

QUERIES = {
    "num_en": Query(_said("orders", "o_orderkey", cents, numbers_en.cardinal), _EN_NUMBER + "SELECT * FROM cardinal"),
    "ordinal_en": Query(_said("orders", "o_orderkey", cents, numbers_en.ordinal), _EN_NUMBER + _EN_ORDINAL),
    "num_fr": Query(_said("orders", "o_orderkey", cents, numbers_fr.cardinal), _FR_NUMBER + "SELECT * FROM cardinal"),
    "ordinal_fr": Query(_said("orders", "o_orderkey", cents, numbers_fr.ordinal), _FR_NUMBER + _FR_ORDINAL),
    "num_fr_hyphenated": Query(
        _said("orders", "o_orderkey", cents, lambda t: numbers_fr.hyphenated(int(t))), _FR_NUMBER + "SELECT o_orderkey, replace(text, ' et ', '-et-') AS text FROM cardinal"
    ),
    "roman_from_number": Query(roman_text, _ROMAN),
    "roman_to_number": Query(roman_value, "SELECT p_partkey, CAST(p_partkey % 3999 + 1 AS VARCHAR) AS text FROM part"),
    "year_en": Query(_said("orders", "o_orderkey", year, numbers_en.year), _YEAR_EN),
    "year_fr": Query(
        _said("orders", "o_orderkey", year, numbers_fr.year),
        f"""WITH {_FR}, x AS (SELECT o_orderkey, 1300 + o_orderkey % 800 AS y FROM orders) SELECT o_orderkey,
  CASE WHEN y >= 2000 THEN 'deux mille' || CASE WHEN y > 2000 THEN ' ' || lo.w ELSE '' END ELSE hi.w || ' cent' || CASE WHEN y % 100 > 0 THEN ' ' || lo.w ELSE '' END END AS text
  FROM x JOIN fr hi ON hi.n = y // 100 JOIN fr lo ON lo.n = y % 100""",
    ),
    "date_en": Query(_said("orders", "o_orderkey", day("M/d/yyyy", "sent ", " by us"), english.date_and_time), _DATE_EN),
    "date_en_named": Query(_said("orders", "o_orderkey", day("MMMM d, yyyy", "sent ", " by us"), english.date_and_time), _DATE_EN),
    "date_fr": Query(
        _said("orders", "o_orderkey", jour, french.date_and_time),
        f"""WITH {_FR}, x AS ({_DATE_PARTS}) SELECT o_orderkey, 'envoyé <DATE> ' || a.w || ' ' || {_MOIS}[m] || ' ' ||
  CASE WHEN y >= 2000 THEN 'deux mille' || CASE WHEN y > 2000 THEN ' ' || lo.w ELSE '' END ELSE hi.w || ' cent' || CASE WHEN y % 100 > 0 THEN ' ' || lo.w ELSE '' END END || ' </DATE> par nous' AS text
  FROM x JOIN fr a ON a.n = d JOIN fr hi ON hi.n = y // 100 JOIN fr lo ON lo.n = y % 100""",
    ),
    "time_en": Query(_said("events", "event_id", clock, english.date_and_time), _TIME_EN),
    "durations_en": Query(durations, _SPAN),
    "currency_en": Query(_said("orders", "o_orderkey", amount("paid $", " today"), english.currencies), _MONEY),
    "currency_fr": Query(_said("orders", "o_orderkey", amount("payé ", " € hier"), french.currencies), _MONEY_FR),
    "units_en": Query(_said("part", "p_partkey", size("about ", " cm wide"), english.units), _SIZE.format("centimeter", "wide")),
    "units_fr": Query(_said("part", "p_partkey", size("about ", " km plus loin"), french.units), _SIZE.format("kilomètre", "plus loin")),
    "units_per_en": Query(
        _said("part", "p_partkey", size("about ", " m/s now"), english.units),
        "SELECT p_partkey, 'about <QUANTITY> ' || p_size || CASE WHEN p_size < 2 THEN ' meter' ELSE ' meters' END || ' per second </QUANTITY> now' AS text FROM part",
    ),
    "telephone_fr": Query(
        _said("customer", "c_custkey", phone, lambda t: cleaning.telephone(t, pairs=True)),
        f"SELECT c_custkey, 'call <PHONE> ' || regexp_replace({_PHONE_DIGITS}, '(..)(..)(..)(..)(.)', '\\1 \\2 \\3 \\4 \\5') || ' </PHONE> now' AS text FROM customer",
    ),
    "telephone_en": Query(_said("customer", "c_custkey", phone, cleaning.telephone)),
    "fractions_en": Query(_said("part", "p_partkey", fractions, lambda t: english.numbers(t, ENGLISH)), _FRACTION),
    "comparisons_en": Query(_said("part", "p_partkey", comparisons, lambda t: english.numbers(t, ENGLISH)), _COMPARE),
    "numbers_en": Query(
        _said("orders", "o_orderkey", lambda: F.concat(F.lit("all "), cents(), F.lit(" of them")), lambda t: english.numbers(t, ENGLISH)),
        _EN_NUMBER + "SELECT o_orderkey, 'all ' || text || ' of them' AS text FROM cardinal",
    ),
    "numbers_fr": Query(
        _said("orders", "o_orderkey", lambda: F.concat(F.lit("les "), cents(), F.lit(" ici")), lambda t: french.numbers(t, FRENCH)),
        _FR_NUMBER + "SELECT o_orderkey, 'les ' || text || ' ici' AS text FROM cardinal",
    ),
}
