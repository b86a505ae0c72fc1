"""Queries of vocabulary analytics over the words of the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import rules, vocabulary
from textloom.operators.columns import rr
from textloom.plans import sql
from textloom.plans.catalog import Query, table
from textloom.session import checkpointed, spread

#: Words of the vocabulary: a report of the top, as a recogniser's size bounds it.
SIZE = 500


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", rr(F.col("text"), (r'([.,;:?!()"])', " $1 ")).alias("text"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams and bigrams of all documents."""
    texts = spaced(spark, sf_dir)
    return vocabulary.word_counts(texts, "text").unionByName(vocabulary.bigram_counts(texts, "text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_counts(spaced(spark, sf_dir), "text")


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.bigram_counts(spaced(spark, sf_dir), "text")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark in small letters."""
    found = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return table(spark, sf_dir, "benchmark").select(found.alias("word")).where("word <> ''").distinct()


def _of(step: Callable[[DataFrame], DataFrame], source=words) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(source(spark, sf_dir))


def _with_vocabulary(step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = words(spark, sf_dir)
        return step(c, vocabulary.vocabulary(c, SIZE))

    return run


def classes(c: DataFrame) -> DataFrame:
    return vocabulary.classes(c).select("kind", "projection", F.array_join("members", "|").alias("members"), "c")


def best_members(c: DataFrame) -> DataFrame:
    return vocabulary.best_of_classes(checkpointed(c), ("dash", "apostrophe", "case"))


def entropy(c: DataFrame, v: DataFrame) -> DataFrame:
    return vocabulary.entropy(c, v).select(*[F.round(n, 6).alias(n) for n in ("entropy", "iv_entropy", "ratio")], F.round("iv_perplexity", 3).alias("iv_perplexity"))


def coverage(c: DataFrame, v: DataFrame) -> DataFrame:
    return vocabulary.coverage(c, v).withColumn("oov_rate", F.round("oov_rate", 9))


def both_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words(spark, sf_dir)
    return vocabulary.both_case_words(c, vocabulary.vocabulary(c, SIZE), lexicon(spark, sf_dir))


def word_rules(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that cut long words after their third letter, and that shout words of three."""
    w = F.col("ngram")
    cut = c.where(F.length(w) > 6).select(w.alias("src"), F.concat(w.substr(1, 3), F.lit(" "), F.expr("substring(ngram, 4)")).alias("dst"))
    shout = c.where((F.length(w) <= 3) & (F.upper(w) != w)).select(w.alias("src"), F.upper(w).alias("dst"))
    return cut, shout


def compose(c: DataFrame) -> DataFrame:
    return vocabulary.compose(*word_rules(c))


def without_conflicts(c: DataFrame) -> DataFrame:
    cut, shout = word_rules(c)
    return vocabulary.without_conflicts(cut.unionByName(shout))


def move_counts(c: DataFrame) -> DataFrame:
    cut, shout = word_rules(c)
    return vocabulary.move_counts(c, cut.unionByName(shout))


def recased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.recased_bigrams(bigrams(spark, sf_dir), vocabulary.vocabulary(words(spark, sf_dir), SIZE))


def rewrite_counts(c: DataFrame) -> DataFrame:
    table_ = c.where(F.lower("ngram") != F.col("ngram")).select(F.col("ngram").alias("pattern"), F.lower("ngram").alias("rewrite"))
    return rules.rewrite_counts(c, table_)


def literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the vocabulary written in capitals, wherever they stand as tokens."""
    c = words(spark, sf_dir)
    pairs = vocabulary.vocabulary(c, SIZE).where(F.upper("ngram") != F.col("ngram"))
    table_ = pairs.select(F.col("ngram").alias("pattern"), F.upper("ngram").alias("rewrite"), F.lit("token").alias("kind"))
    return rules.rewrite_tokens(spaced(spark, sf_dir), "text", table_)


def new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checkpointed(words(spark, sf_dir))  # counted once, looked up many times
    return vocabulary.new_rules(c, vocabulary.vocabulary(c, SIZE), lexicon(spark, sf_dir))


def minimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_, _ = vocabulary.minimise_oov(spark, counts(spark, sf_dir), SIZE, lexicon(spark, sf_dir))
    return rules_


def with_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.with_unknown_word(bigrams(spark, sf_dir), vocabulary.vocabulary(words(spark, sf_dir), SIZE))


def printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, shout = word_rules(words(spark, sf_dir))
    return vocabulary.printable(cut.unionByName(shout))


_UNI = "WITH " + sql.COUNTS
_VOCAB = _UNI + f", v AS MATERIALIZED (SELECT ngram, c FROM uni WHERE c > 0 ORDER BY c DESC, ngram LIMIT {SIZE}), f AS MATERIALIZED (SELECT ngram, c, ngram IN (SELECT ngram FROM v) AS iv FROM uni)"
_LEXICON = "lex AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE w <> '')"
_DASH = sql.rr("ngram", ("-( |$)", r"\1"), ("(^| )-", r"\1"), ("-", " "))
_APOSTROPHE = sql.rr("ngram", ("'( |$)", r"\1"), ("(^| )'", r"\1"), ("'", " "))
_HEAD = "regexp_extract(ngram, '^(.*?(?:^| |-)[A-Z]|)(?s:.*)$', 1)"
_CASE = f"CASE WHEN length({_HEAD}) > 0 THEN {_HEAD} || lower(substr(ngram, length({_HEAD}) + 1)) ELSE ngram END"
_PROJECTED = " UNION ALL ".join(f"SELECT '{k}' AS kind, {p} AS projection, ngram, c FROM uni" for k, p in (("dash", _DASH), ("apostrophe", _APOSTROPHE), ("case", _CASE)))
_CATEGORIES = f"""
cat AS (SELECT ngram, c, iv, regexp_matches(ngram, '^[A-Z0-9][.\\-]?[A-Z0-9.\\-&]+(?:s''?|''s)?$') AS a,
  regexp_matches(ngram, '^(?:\\d+|\\w\\.?)(?:s''?|''s)?$') AS o, regexp_matches(ngram, '(?i)[a-z0-9]-[a-z0-9]') AS h,
  regexp_matches(ngram, '(?i)^-[a-z0-9]') AS s, regexp_matches(ngram, '(?i)^[a-z0-9]-') AS p,
  regexp_matches(ngram, '(?i)''s?$') AS g, regexp_matches(ngram, '(?i)[a-z0-9]''[a-z0-9]') AS q, regexp_matches(ngram, '^[A-Z][a-z]') AS k FROM f),
named AS (SELECT c, iv, unnest([CASE WHEN a THEN 'Acronyms' END, CASE WHEN o AND NOT a THEN '1-char words' END, CASE WHEN h THEN 'Hyphenated words' END,
  CASE WHEN s AND NOT h THEN 'Suffixes' END, CASE WHEN p AND NOT h AND NOT s THEN 'Prefixes' END, CASE WHEN g THEN 'Saxon genitive' END,
  CASE WHEN q THEN 'With apostrophe' END, CASE WHEN k THEN 'Cased words' END]) AS category FROM cat)
"""
_RULES = """
cut AS (SELECT ngram AS src, ngram[:3] || ' ' || ngram[4:] AS dst FROM uni WHERE length(ngram) > 6),
shout AS (SELECT ngram AS src, upper(replace(ngram, 'ß', 'SS')) AS dst FROM uni WHERE length(ngram) <= 3 AND upper(replace(ngram, 'ß', 'SS')) <> ngram),
rules AS MATERIALIZED (SELECT * FROM cut UNION ALL SELECT * FROM shout)
"""
_PLAIN = "lower(" + sql.rr("ngram", ("^([EIei])-", r"\1."), ("[-'_]", ""), (r"([AOU])\.", r"\1")) + ")"
_SWAPPED = "CASE WHEN regexp_matches({0}[:1], '[A-Z]') THEN lower({0}[:1]) ELSE upper({0}[:1]) END || {0}[2:]"

QUERIES = {
    "word_counts": Query(words, _UNI + "SELECT ngram, c FROM uni"),
    "bigram_counts": Query(bigrams, _UNI + "SELECT ngram, c FROM bi"),
    "load_counts": Query(
        _of(lambda c: vocabulary.load_counts(c, 3), counts),
        _UNI + "SELECT ngram, c FROM counts WHERE len(string_split(ngram, ' ')) = 2 OR len(string_split(ngram, ' ')) = 1 AND c >= 3",
    ),
    "counts_in_bigrams": Query(_of(vocabulary.in_bigrams, bigrams), _UNI + "SELECT w AS ngram, CAST(sum(c) AS BIGINT) AS c FROM (SELECT unnest(string_split(ngram, ' ')) AS w, c FROM bi) GROUP BY w"),
    "vocab_classes": Query(_of(classes), _UNI + f"SELECT kind, projection, string_agg(ngram, '|' ORDER BY ngram) AS members, CAST(sum(c) AS BIGINT) AS c FROM ({_PROJECTED}) GROUP BY 1, 2"),
    "vocab_best_members": Query(
        _of(best_members),
        _UNI
        + f""", p AS MATERIALIZED ({_PROJECTED}),
a AS (SELECT kind, projection, list({{'ngram': ngram, 'c': c}} ORDER BY c DESC, ngram) AS o FROM p GROUP BY 1, 2)
SELECT ngram, CASE WHEN regexp_matches(ngram, '''(?:[dmst]|ll|ve)$') OR coalesce(o[1].c = o[2].c AND lower(o[1].ngram) = lower(o[2].ngram), false) THEN ngram ELSE o[1].ngram END AS best, p.kind
FROM p JOIN a ON a.kind = p.kind AND a.projection = p.projection""",
    ),
    "vocab_potentials": Query(
        _of(vocabulary.potentials),
        _UNI
        + r""", s AS (SELECT ngram, c, regexp_extract(ngram, '^(.+?)-(.+)$', 1) AS a, regexp_extract(ngram, '^(.+?)-(.+)$', 2) AS b FROM uni),
x AS (SELECT ngram AS part, c FROM s UNION ALL SELECT unnest([a, a || '-', b, '-' || b]), c FROM s WHERE a <> '')
SELECT part, CAST(sum(c) AS BIGINT) AS c FROM x GROUP BY part""",
    ),
    "vocab_topk": Query(_of(lambda c: vocabulary.vocabulary(c, SIZE)), _VOCAB + "SELECT ngram, c FROM v"),
    "vocab_ranked": Query(_of(lambda c: vocabulary.ranked_vocabulary(c, SIZE)), _VOCAB + "SELECT ngram, c, row_number() OVER (ORDER BY c DESC, ngram) AS rank FROM v"),
    "vocab_flagged": Query(_with_vocabulary(vocabulary.flagged), _VOCAB + "SELECT ngram, c, iv FROM f"),
    "oov_words": Query(_with_vocabulary(vocabulary.out_of_vocabulary), _VOCAB + "SELECT ngram, c FROM f WHERE NOT iv"),
    "oov_coverage": Query(
        _with_vocabulary(coverage),
        _VOCAB
        + """SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS words, CAST(sum(CASE WHEN iv THEN c ELSE 0 END) AS BIGINT) AS iv_total, count(*) FILTER (iv) AS iv_words,
CAST(sum(CASE WHEN iv THEN 0 ELSE c END) AS BIGINT) AS oov_total, count(*) FILTER (NOT iv) AS oov_words, round(sum(CASE WHEN iv THEN 0 ELSE c END) / sum(c), 9) AS oov_rate FROM f""",
    ),
    "oov_categories": Query(
        _with_vocabulary(vocabulary.category_report),
        _VOCAB + ", " + _CATEGORIES + "SELECT category, iv, CAST(sum(c) AS BIGINT) AS total, count(*) AS words FROM named WHERE category IS NOT NULL GROUP BY GROUPING SETS ((category, iv), (category))",
    ),
    "entropy_perplexity": Query(
        _with_vocabulary(entropy),
        _VOCAB
        + """, t AS (SELECT sum(c) AS t FROM f), h AS (SELECT iv, -(c / t) * log2(c / t) AS h FROM f, t), e AS (SELECT sum(h) AS e, sum(CASE WHEN iv THEN h ELSE 0 END) AS i FROM h)
SELECT round(e, 6) AS entropy, round(i, 6) AS iv_entropy, round(i / e, 6) AS ratio, round(pow(2, i), 3) AS iv_perplexity FROM e""",
    ),
    "both_case_words": Query(
        both_case,
        _VOCAB
        + f", {_LEXICON} SELECT f.ngram, f.c, f.iv, s.ngram AS small, s.c AS small_c, s.iv AS small_iv FROM f JOIN f s ON s.ngram = lower(f.ngram) WHERE regexp_matches(f.ngram, '^[A-Z]') AND lower(f.ngram) IN (SELECT word FROM lex)",
    ),
    "confusability": Query(
        _of(lambda c: vocabulary.confusability(c.select("ngram"))),
        _UNI.replace("WITH", "WITH RECURSIVE", 1)
        + f""", k AS MATERIALIZED (SELECT ngram, {_PLAIN} AS w FROM uni), n AS MATERIALIZED (SELECT w, count(*) AS n FROM k GROUP BY w),
cut AS MATERIALIZED (SELECT x.*, EXISTS (FROM n WHERE n.w = x.a) AS known FROM (SELECT w, w[:i] AS a, w[i + 1:] AS b FROM (SELECT w, unnest(range(1, length(w))) AS i FROM n WHERE length(w) > 1)) x
  WHERE regexp_matches(a, '[aeiou.]') AND regexp_matches(b, '[aeiou.]') AND EXISTS (FROM n WHERE n.w = x.b)),
pq AS (SELECT a, a[:i] AS p, a[i + 1:] AS q FROM (SELECT a, unnest(range(1, length(a))) AS i FROM (SELECT DISTINCT a FROM cut WHERE NOT known AND length(a) BETWEEN 2 AND 9))
  WHERE regexp_matches(a[:i], '[aeiouy.]') AND regexp_matches(a[i + 1:], '[aeiouy.]')),
o AS (SELECT a, list_sort([[len_p, p, np], [len_q, q, nq]]) AS o FROM (SELECT a, lpad(CAST(length(p) AS VARCHAR), 3, '0') AS len_p, p, CAST(x.n AS VARCHAR) AS np,
  lpad(CAST(length(q) AS VARCHAR), 3, '0') AS len_q, q, CAST(y.n AS VARCHAR) AS nq FROM pq JOIN n x ON x.w = p JOIN n y ON y.w = q)),
glued AS (SELECT a, m[1][2] AS x, m[1] = m[2] AS twice, CASE WHEN m[1] = m[2] THEN 1 ELSE CAST(m[2][3] AS BIGINT) END AS k FROM (SELECT a, min(o) AS m FROM o GROUP BY a)),
todo AS MATERIALIZED (SELECT w, a AS x, CAST(1 AS BIGINT) AS k, false AS twice, b AS y FROM cut WHERE known
  UNION ALL SELECT w, x, k, twice, b FROM cut JOIN glued ON glued.a = cut.a WHERE NOT known),
level(w, ways) USING KEY (w) AS (SELECT w, n FROM n UNION
  SELECT s.w, s.ways FROM (SELECT t.w, CAST(any_value(n.n) + sum(t.k * x.ways * CASE WHEN t.twice THEN x.ways ELSE 1 END * y.ways) AS BIGINT) AS ways
    FROM todo t JOIN recurring.level x ON x.w = t.x JOIN recurring.level y ON y.w = t.y JOIN n ON n.w = t.w GROUP BY t.w) s
  JOIN recurring.level r ON r.w = s.w WHERE r.ways <> s.ways)
SELECT k.ngram, level.ways AS variants FROM k JOIN level ON level.w = k.w""",
    ),
    "rules_compose": Query(
        _of(compose),
        _UNI
        + ", "
        + _RULES
        + """SELECT src, coalesce(a.dst, x.a) || ' ' || coalesce(b.dst, x.b) AS dst FROM (SELECT src, src[:3] AS a, src[4:] AS b FROM cut) x
LEFT JOIN (SELECT src AS s, dst FROM shout) a ON a.s = x.a LEFT JOIN (SELECT src AS s, dst FROM shout) b ON b.s = x.b UNION ALL SELECT * FROM shout""",
    ),
    "rules_without_conflicts": Query(
        _of(without_conflicts),
        _UNI + ", " + _RULES + ", made AS MATERIALIZED (SELECT unnest(string_split(dst, ' ')) AS w FROM rules UNION SELECT dst FROM rules) SELECT src, dst FROM rules ANTI JOIN made ON made.w = rules.src",
    ),
    "rules_move_counts": Query(
        _of(move_counts),
        _UNI
        + ", "
        + _RULES
        + """, hit AS (SELECT src, dst, c FROM rules JOIN uni ON ngram = src),
d AS (SELECT ngram, c FROM uni UNION ALL SELECT src, -c FROM hit UNION ALL SELECT dst, c FROM hit UNION ALL SELECT unnest(string_split(dst, ' ')), c FROM hit WHERE dst LIKE '% %')
SELECT ngram, CAST(sum(c) AS BIGINT) AS c FROM d GROUP BY ngram HAVING sum(c) > 0""",
    ),
    "rules_on_counts": Query(_of(rewrite_counts), _UNI + "SELECT lower(ngram) AS ngram, CAST(sum(c) AS BIGINT) AS c FROM uni GROUP BY 1"),
    "rules_literal_tokens": Query(
        literal_rules,
        _VOCAB
        + f""", r AS (SELECT ngram AS p, upper(replace(ngram, 'ß', 'SS')) AS r FROM v WHERE upper(replace(ngram, 'ß', 'SS')) <> ngram),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split({sql.SPACED}, ' ') AS ws FROM documents)),
x AS (SELECT doc_id, i, ws[i] AS w, regexp_replace(ws[i], '''[sS]?$', '') AS stem, regexp_extract(ws[i], '(''[sS]?)$', 1) AS clitic FROM w)
SELECT doc_id, string_agg(coalesce(a.r, b.r || clitic, x.w), ' ' ORDER BY i) AS text
FROM x LEFT JOIN r a ON a.p = x.w LEFT JOIN r b ON b.p = x.stem AND x.clitic <> '' GROUP BY doc_id""",
    ),
    "rules_printable": Query(
        printable,
        _UNI
        + ", "
        + _RULES
        + r"""SELECT regexp_replace(src, '([.?*+])', '\\\1', 'g') || ' => ' || dst AS line FROM rules WHERE src <> dst AND src NOT LIKE '%,%'
AND NOT regexp_matches(src, '\(.*\)') AND NOT regexp_matches(dst, '\(.*\)') AND length(regexp_replace(src, '[^A-Za-z0-9]', '', 'g')) < 21""",
    ),
    "bigram_recasing": Query(
        recased,
        _VOCAB
        + rf""", p AS (SELECT ngram, c, split_part(ngram, ' ', 1) AS a, split_part(ngram, ' ', 2) AS b FROM bi WHERE regexp_full_match(ngram, '([A-Za-z])([^ \-'']+) ([A-Za-z])([^ \-'']+)')),
o AS (SELECT p.*, va.ngram IS NULL AS oa, vb.ngram IS NULL AS ob FROM p LEFT JOIN v va ON va.ngram = p.a LEFT JOIN v vb ON vb.ngram = p.b),
g AS (SELECT ngram, c, x || ' ' || y AS dst FROM (SELECT ngram, c, x, unnest(CASE WHEN ob THEN [b, {_SWAPPED.format('b')}] ELSE [b] END) AS y
  FROM (SELECT ngram, c, b, ob, unnest(CASE WHEN oa THEN [a, {_SWAPPED.format('a')}] ELSE [a] END) AS x FROM o WHERE oa OR ob))),
s AS (SELECT g.ngram, g.c, g.dst, counts.c AS n, row_number() OVER (PARTITION BY g.ngram ORDER BY counts.c DESC, g.dst DESC) AS r FROM g JOIN counts ON counts.ngram = g.dst)
SELECT ngram AS src, dst FROM s WHERE r = 1 AND n > 5 * c AND dst <> ngram""",
    ),
    "letter_ngrams": Query(
        lambda spark, sf_dir: vocabulary.letter_ngrams(lexicon(spark, sf_dir), 3),
        f"""WITH {_LEXICON} SELECT letters, count(*) AS n FROM (SELECT DISTINCT word, f[i:i + 2] AS letters FROM
(SELECT word, '^' || word || '$' AS f, unnest(range(1, length(word) + 1)) AS i FROM lex)) GROUP BY letters""",
    ),
    "bigrams_with_unknown_word": Query(
        with_unknown,
        _VOCAB + "SELECT ngram, c FROM bi WHERE split_part(ngram, ' ', 1) NOT IN (SELECT ngram FROM v) OR split_part(ngram, ' ', 2) NOT IN (SELECT ngram FROM v)",
    ),
    "rules_whole_ngrams": Query(
        _of(lambda c: rules.map_counts(c, rules.RuleSet(rules.parse(["[0-9]+ => NUMBER", "NUMBER => N", "the => THE", "The => THE"])))),
        _UNI + "SELECT CASE WHEN regexp_full_match(ngram, '[0-9]+') OR ngram = 'NUMBER' THEN 'N' WHEN ngram IN ('the', 'The') THEN 'THE' ELSE ngram END AS ngram, CAST(sum(c) AS BIGINT) AS c FROM uni GROUP BY 1",
    ),
    "oov_new_rules": Query(new_rules),
    "oov_minimisation": Query(minimised),
}
