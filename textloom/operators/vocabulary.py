"""Vocabulary analytics: counts, classes, coverage, and rules that lower the OOV rate.

Counts are DataFrames (ngram, c); everything but the wording of single words is
relational.  The rule loop keeps its state in tables and cuts lineage between
passes by writing to the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import numbers_en
from textloom.functions.patterns import CAPITAL, CAPITAL_OR_DIGIT, LETTER, fixpoint, sub
from textloom.operators.columns import rr
from textloom.session import checkpointed


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of blank-separated words."""
    words = df.select(F.explode(F.split(F.col(column), r"[ \n]+")).alias("ngram")).where("ngram <> ''")
    return words.groupBy("ngram").agg(F.count(F.lit(1)).alias("c"))


def bigram_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of neighbouring words within a line."""
    lines = df.select(F.explode(F.split(F.col(column), "\n")).alias("line"))
    words = F.filter(F.split("line", " +"), lambda w: w != "")
    pairs = lines.select(words.alias("w")).where(F.size("w") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).alias("ngram")
    )
    return pairs.groupBy("ngram").agg(F.count(F.lit(1)).alias("c"))


def load_counts(counts: DataFrame, min_count: int = 1, order: int = 2) -> DataFrame:
    """Counts of up to ``order`` words: duplicates add up, rare unigrams go, bigrams stay."""
    size = F.size(F.split("ngram", " "))
    kept = counts.where((size <= order) & ((size > 1) | (F.col("c") >= min_count)))
    return kept.groupBy("ngram").agg(F.sum("c").alias("c"))


def unigrams(counts: DataFrame) -> DataFrame:
    return counts.where(~F.contains("ngram", F.lit(" ")))


def in_bigrams(counts: DataFrame) -> DataFrame:
    """Unigram counts inside bigrams."""
    pairs = counts.where(F.size(F.split("ngram", " ")) == 2)
    return pairs.select(F.explode(F.split("ngram", " ")).alias("ngram"), "c").groupBy("ngram").agg(F.sum("c").alias("c"))


def letter_ngrams(words: DataFrame, order: int) -> DataFrame:
    """letters, n: runs of letters within words, between the marks ^ and $, by the words that hold them."""
    framed = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w")).where(F.length("w") >= order)
    starts = F.sequence(F.lit(1), F.length("w") - (order - 1))
    runs = framed.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("w").substr(i, F.lit(order))))).alias("letters"))
    return runs.groupBy("letters").agg(F.count(F.lit(1)).alias("n"))


def with_unknown_word(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """N-grams with a word out of the vocabulary."""
    words = counts.select("ngram", "c", F.explode(F.array_distinct(F.split("ngram", " "))).alias("w"))
    unknown = words.join(F.broadcast(vocab.select(F.col("ngram").alias("w"))), "w", "left_anti")  # its size bounds it
    return unknown.select("ngram", "c").distinct()


def project_dash(w: Column) -> Column:
    return rr(w, ("-( |$)", "$1"), ("(^| )-", "$1"), ("-", " "))


def project_apostrophe(w: Column) -> Column:
    return rr(w, ("'( |$)", "$1"), ("(^| )'", "$1"), ("'", " "))


def project_case(w: Column) -> Column:
    """Small letters after the first capital of a word or of a hyphenated part."""
    head = F.regexp_extract(w, "^(.*?(?:^| |-)[A-Z]|)(?s:.*)$", 1)
    return F.concat(head, F.when(F.length(head) > 0, F.lower(F.substring(w, F.length(head) + 1, F.length(w)))).otherwise(w))


def classes(counts: DataFrame) -> DataFrame:
    """kind, projection, members: words that differ in hyphens, apostrophes or case alone."""
    w = F.col("ngram")
    kinds = F.array(
        F.struct(F.lit("dash").alias("kind"), project_dash(w).alias("projection")),
        F.struct(F.lit("apostrophe").alias("kind"), project_apostrophe(w).alias("projection")),
        F.struct(F.lit("case").alias("kind"), project_case(w).alias("projection")),
    )
    one = unigrams(counts).select("ngram", "c", F.explode(kinds).alias("k"))
    return one.groupBy("k.kind", "k.projection").agg(F.sort_array(F.collect_list("ngram")).alias("members"), F.sum("c").alias("c"))


_PROJECTIONS = {"dash": project_dash, "apostrophe": project_apostrophe, "case": project_case}


def best_of_classes(counts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """ngram, best, kind: the most frequent word of its class, for each kind; a word whose
    class's two best draw and differ in case only stays, and so do contractions."""
    every = F.array(*[F.struct(F.lit(k).alias("kind"), _PROJECTIONS[k](F.col("ngram")).alias("p")) for k in kinds])
    one = unigrams(counts).select("ngram", "c", F.explode(every).alias("k")).select("ngram", "c", "k.kind", "k.p")
    by_count = Window.partitionBy("kind", "p").orderBy(F.desc("c"), "ngram")
    top = one.withColumn("r", F.row_number().over(by_count)).where("r <= 2")  # a partition hands on two a class
    pick = top.groupBy("kind", "p").agg(
        F.max(F.when(F.col("r") == 1, F.struct("ngram", "c"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("ngram", "c"))).alias("b")
    )
    draw = F.coalesce((F.col("a.c") == F.col("b.c")) & (F.lower("a.ngram") == F.lower("b.ngram")), F.lit(False))
    stays = F.col("ngram").rlike("'(?:[dmst]|ll|ve)$")
    return one.join(pick, ["kind", "p"]).select("ngram", F.when(stays | draw, F.col("ngram")).otherwise(F.col("a.ngram")).alias("best"), "kind")


def best_members(counts: DataFrame, kind: str) -> DataFrame:
    """ngram, best of one kind of class."""
    return best_of_classes(counts, (kind,)).select("ngram", "best")


def potentials(counts: DataFrame) -> DataFrame:
    """part, c: how often a word stands alone, or before or after the first hyphen."""
    one = unigrams(counts)
    a, b = F.regexp_extract("ngram", "^(.+?)-(.+)$", 1), F.regexp_extract("ngram", "^(.+?)-(.+)$", 2)
    parts = F.when(a != "", F.array("ngram", a, F.concat(a, F.lit("-")), b, F.concat(F.lit("-"), b))).otherwise(F.array("ngram"))
    return one.select(F.explode(parts).alias("part"), "c").groupBy("part").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent words; draws by the alphabet."""
    return unigrams(counts).where("c > 0").orderBy(F.desc("c"), "ngram").limit(size)


def ranked_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The vocabulary with ranks from 1."""
    top = vocabulary(counts, size)  # at most ``size`` rows reach the single-partition window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "ngram")))


def out_of_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    return unigrams(counts).join(vocab.select("ngram"), "ngram", "left_anti")


def flagged(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Unigrams with iv: are they in the vocabulary?"""
    known = vocab.select("ngram", F.lit(True).alias("iv"))
    return unigrams(counts).where("c > 0").join(known, "ngram", "left").withColumn("iv", F.coalesce("iv", F.lit(False)))


CATEGORIES = {
    "Acronyms": r"^[A-Z0-9][.\-]?[A-Z0-9.\-&]+(?:s'?|'s)?$",
    "1-char words": r"^(?:\w\.?|\d+)(?:'s|s'?)?$",
    "Hyphenated words": "(?i)[a-z0-9]-[a-z0-9]",
    "Suffixes": "(?i)^-[a-z0-9]",
    "Prefixes": "(?i)^[a-z0-9]-",
    "Saxon genitive": "(?i)'s?$",
    "With apostrophe": "(?i)[a-z0-9]'[a-z0-9]",
    "Cased words": "^[A-Z][a-z]",
}


def categories_of(w: Column) -> Column:
    """All categories of a word, as an array."""
    has = {k: w.rlike(v) for k, v in CATEGORIES.items()}
    has["1-char words"] &= ~has["Acronyms"]
    has["Suffixes"] &= ~has["Hyphenated words"]
    has["Prefixes"] &= ~has["Hyphenated words"] & ~has["Suffixes"]
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in has.items()]), lambda x: x.isNotNull())


def coverage(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: totals, in and out of vocabulary, and rates."""
    f = flagged(counts, vocab)
    iv = F.col("iv")
    return f.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("words"),
        F.coalesce(F.sum(F.when(iv, F.col("c")).otherwise(0)), F.lit(0)).alias("iv_total"),
        F.count_if(iv).alias("iv_words"),
    ).select(
        "*",
        (F.col("total") - F.col("iv_total")).alias("oov_total"),
        (F.col("words") - F.col("iv_words")).alias("oov_words"),
        F.try_divide(F.col("total") - F.col("iv_total"), F.col("total")).alias("oov_rate"),
    )


def category_report(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """category, iv (null: both), total, words: by rollup."""
    f = flagged(counts, vocab).select("c", "iv", F.explode(categories_of(F.col("ngram"))).alias("category"))
    return (
        f.rollup("category", "iv")
        .agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("words"), F.grouping("category").alias("g"))
        .where("g = 0")
        .drop("g")
    )


def entropy(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Entropy in bits of all words and of the vocabulary, their ratio, and perplexity."""
    f = flagged(counts, vocab)
    total = f.agg(F.sum("c").cast("double").alias("total"))
    p = F.col("c") / F.col("total")
    each = f.crossJoin(F.broadcast(total)).withColumn("h", -p * F.log2(p))  # one row is broadcast
    return each.agg(F.sum("h").alias("entropy"), F.coalesce(F.sum(F.when(F.col("iv"), F.col("h"))), F.lit(0.0)).alias("iv_entropy")).select(
        "*", (F.col("iv_entropy") / F.col("entropy")).alias("ratio"), F.pow(F.lit(2.0), F.col("iv_entropy")).alias("iv_perplexity")
    )


def both_case_words(counts: DataFrame, vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Capitalised words whose small form counts too and is in the lexicon (word)."""
    f = flagged(counts, vocab)
    small = f.select(F.col("ngram").alias("small"), F.col("c").alias("small_c"), F.col("iv").alias("small_iv"))
    return (
        f.where(F.col("ngram").rlike("^[A-Z]"))
        .withColumn("small", F.lower("ngram"))
        .join(lexicon.select(F.col("word").alias("small")).distinct(), "small", "left_semi")
        .join(small, "small")
        .select("ngram", "c", "iv", "small", "small_c", "small_iv")
    )


def confusability(words: DataFrame) -> DataFrame:
    """ngram, variants: the ways in which a word is made of known words with vowels.

    A form's ways are how many spellings it has, and for each cut into a head and a
    known word the product of their ways, so that splits into three and more words
    count.  A head is a known word, or is glued from two that are no word themselves:
    such a prefix of 2 to 9 letters has the ways of its shortest piece (draws by the
    alphabet) times the spellings of the other.

    Ways go from parts to wholes, a pass for each depth of cuts; each pass is written.
    """
    plain = F.lower(rr(F.col("ngram"), ("^([EIei])-", "$1."), ("[-'_]", ""), (r"([AOU])\.", "$1")))
    keyed = checkpointed(words.select("ngram", plain.alias("w")))
    forms = checkpointed(keyed.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    vowel, sounding = "[aeiou.]", "[aeiouy.]"

    def cuts(df: DataFrame, column: str, a: str, b: str) -> DataFrame:
        every = df.where(F.length(column) > 1).select("*", F.explode(F.sequence(F.lit(1), F.length(column) - 1)).alias("at"))
        return every.select("*", F.expr(f"left({column}, at)").alias(a), F.expr(f"substring({column}, at + 1)").alias(b)).drop("at")

    def named(column: str, n: str) -> DataFrame:
        return forms.select(F.col("w").alias(column), F.col("n").alias(n))

    cut = cuts(forms.select("w"), "w", "a", "b").where(F.col("a").rlike(vowel) & F.col("b").rlike(vowel))
    cut = checkpointed(cut.join(named("b", "nb").select("b"), "b", "left_semi").join(named("a", "na"), "a", "left"))
    whole = cut.where("na IS NOT NULL").select("w", F.col("a").alias("x"), F.lit(1).cast("long").alias("k"), F.lit(False).alias("twice"), F.col("b").alias("y"))
    heads = cut.where("na IS NULL AND length(a) <= 9").select("a").distinct()
    pairs = cuts(heads, "a", "p", "q").where(F.col("p").rlike(sounding) & F.col("q").rlike(sounding)).join(named("p", "np"), "p").join(named("q", "nq"), "q")
    rank = lambda c, n: F.struct(F.length(c).alias("size"), F.col(c).alias("part"), F.col(n).alias("n"))
    pairs = pairs.select("a", F.array_sort(F.array(rank("p", "np"), rank("q", "nq"))).alias("o"))
    glued = pairs.groupBy("a").agg(F.min("o").alias("o")).select(
        "a", F.col("o")[0]["part"].alias("x"), F.when(F.col("o")[0] == F.col("o")[1], F.lit(1).cast("long")).otherwise(F.col("o")[1]["n"]).alias("k"), (F.col("o")[0] == F.col("o")[1]).alias("twice")
    )
    todo = checkpointed(whole.unionByName(cut.where("na IS NULL").join(glued, "a").select("w", "x", "k", "twice", F.col("b").alias("y"))).join(forms, "w"))
    done = checkpointed(forms.join(todo.select("w").distinct(), "w", "left_anti").select("w", F.col("n").alias("ways")))
    while todo.limit(1).count():  # parts are shorter than wholes, so every pass settles the shortest at least
        known = todo.join(done.select(F.col("w").alias("x"), F.col("ways").alias("wx")), "x", "left").join(done.select(F.col("w").alias("y"), F.col("ways").alias("wy")), "y", "left")
        ways = F.col("k") * F.col("wx") * F.when(F.col("twice"), F.col("wx")).otherwise(1) * F.col("wy")
        settled = checkpointed(known.groupBy("w").agg(F.count_if(ways.isNull()).alias("open"), F.sum(ways).alias("ways"), F.first("n").alias("n")).where("open = 0").select("w", (F.col("n") + F.col("ways")).alias("ways")))
        done = done.unionByName(settled)  # a written table a pass
        todo = checkpointed(todo.join(settled.select("w"), "w", "left_anti"))
    return keyed.join(done, "w").select("ngram", F.col("ways").alias("variants"))


# ---- rules that lower the OOV rate ----


@dataclasses.dataclass(frozen=True)
class Protection:
    """What the output keeps: genitives as they are, or upper case throughout."""

    saxon: bool = False
    uppercase: bool = False


_CONTRACTION = re.compile(r".*'(?:[dmt]|ll|re|ve)", re.I)


def explode_acronym(w: str, upper: bool = False) -> str:
    say = numbers_en.cardinal
    if re.search(r"\d", w):
        for n, name in ((4, "four"), (3, "triple"), (2, "double")):
            w = re.sub(rf"(\d)\1{{{n - 1}}}", rf" {name} \1 ", w)
        w = re.sub(r"(\d)\.(?=\d)", r"\1 point ", w)
        w = fixpoint(r"(\d+)(\d{2})", lambda m: f"{m[1]} {say(m[2])} ", w)
        w = re.sub(r"\d\d?", lambda m: f" {say(m[0])} ", w)
        w = re.sub(r"ty s$", "ties", w)
    elif "&" in w:
        w = w.replace("&", " and ")
    else:
        w = re.sub(r"([A-Z]\.)\1\1\1", r" four \1 ", w)
        w = re.sub(r"([A-Z]\.)\1\1", r" triple \1 ", w)
        w = re.sub(r"([A-Z]\.)(?=[^ ])", r"\1 ", w)
        w = re.sub(r"([A-Z])(?!\.)", r"\1.", w)
    w = re.sub(r" s$", "s", " ".join(w.replace("-", " ").split()))
    return w.upper() if upper else w


def try_apostrophe(w: str, p: Protection, known: dict[str, bool], count: dict[str, int]) -> str:
    """Where a word with an apostrophe is cut."""
    if p.saxon and re.search("(?:'S|S')$" if p.uppercase else "(?:'s|s')$", w):
        return w
    m = re.fullmatch(r"(.*)'s", w, re.I) or re.fullmatch(r"(.*s)'", w, re.I)
    if m:
        return m[1] + (" 'S" if p.uppercase else " 's")
    if _CONTRACTION.fullmatch(w):
        return w
    short = re.compile(r"d|ve|re|ll|m|s|t", re.I)
    if w.startswith("'"):
        return w if short.fullmatch(w[1:]) else w[1:]
    if w.endswith("'"):
        return w[:-1]
    m = re.fullmatch(f"({CAPITAL}{LETTER}+)'([a-rtz]+)", w)
    if m and not p.uppercase:
        return w if short.fullmatch(m[2]) else m[1] + m[2]
    a, _, b = w.rpartition("'")
    left, right = known.get(a + "'", False), known.get("'" + b, False)
    if left and right:
        return f"{a} '{b}" if count.get(a + "'", 0) < count.get("'" + b, 0) else f"{a}' {b}"
    if right or not left and known.get(a, False):
        return f"{a} '{b}"
    if left or known.get(b, False) or count.get(a, 0) < count.get(b, 0):
        return f"{a}' {b}"
    return f"{a} '{b}" if count.get(a, 0) > 0 else f"{a} {b}"


_CONSONANTS = "bcdfghjklmnpqrstvwxz"


def transform_oov(w: str, x: dict, p: Protection = Protection()) -> str:
    """The rewritten form of an unknown word, from what the joins looked up for it.

    ``x`` has best_apostrophe, best_case, head_in_lexicon, left, right (potentials
    of the parts beside the first hyphen), known and count of the parts beside the
    last apostrophe.
    """
    free, old = not p.uppercase, w
    say, nth = numbers_en.cardinal, numbers_en.ordinal
    m = re.fullmatch(f"({CAPITAL}.+?)-({LETTER}.+)", w)
    if free and m and x.get("head_in_lexicon"):
        return m[1].lower() + "-" + m[2]
    if "-" in w and re.match("[a-z]", w):
        if w.endswith("-"):
            w = w[:-1]
        else:
            a, _, b = w.partition("-")
            w = f"{a}- {b}" if (x.get("left") or 0) > (x.get("right") or 0) else f"{a} -{b}"
    if w == old and "'" in w:
        w = try_apostrophe(w, p, x.get("known") or {}, x.get("count") or {})
        if w == old:
            return x.get("best_apostrophe") or w
    if w != old:
        return w
    if w.startswith("."):
        return "dot " + w[1:]
    if free:
        if re.fullmatch("[A-Z]", w):
            return w + "."
        if re.fullmatch(r"[b-z]\.?", w):
            return w[0].upper() + "."
        if re.fullmatch("[A-Z]{2,}", w):
            return w[0] + w[1:].lower()
        if re.fullmatch(f"[{_CONSONANTS.upper()}][{_CONSONANTS}]", w) and w != "Mc":
            return f"{w[0]}.{w[1].upper()}."
        if re.fullmatch(f"[{_CONSONANTS}]{{2,}}", w) and not re.fullmatch("hm+|brr+|grr+|shh+", w):
            return "".join(c.upper() + "." for c in w)
        if re.fullmatch("[A-Z]+s'?s?", w) and re.search(f"[{_CONSONANTS.upper()}]{{2}}", w):
            return re.sub("([A-Z])", r"\1.", w)
    if re.search(r"[A-Z0-9]\.", w) and re.search("[a-z]", w):
        parted = " ".join(sub(rf"((?:{CAPITAL_OR_DIGIT}\.)+)", r" \1 ", w).split())
        if parted != w:
            return parted
    if free and re.fullmatch(rf"{CAPITAL_OR_DIGIT}[.]?(?:&?[A-Z\d-][.]?)+s?'?s?", w):
        new = explode_acronym(w)
    elif p.uppercase and re.fullmatch(rf"(?:\d|{CAPITAL}[.])(?:[&-]?(?:\d|{CAPITAL}[.])[.]?)+S?'?S?", w):
        new = explode_acronym(w, True)
    else:
        new = w
    if new != w:
        return new
    cased = str.upper if p.uppercase else str
    m = re.fullmatch(r"([^\W\d_]+)(\d+(?:[.]\d+)?)(nd|rd|st|th)?", w, re.I)
    if m:
        return cased(f"{m[1]} {nth(m[2]) if m[3] else say(m[2])}")
    m = re.fullmatch(rf"({CAPITAL}{LETTER}+)({CAPITAL}[^\W\d_]+)", w)
    if m:
        return f"{m[1]} {m[2]}"
    if re.fullmatch(r"\d*(?:1st|2nd|3rd|\dth)", w):
        return cased(nth(re.sub(r"\D", "", w)))
    if re.fullmatch(r"\d+(?:\.\d+)?", w):
        return cased(say(w))
    if "-" in w:
        return " ".join(w.replace("-", " ").split())
    return w


#: Words that no rewriting changes have none of these: a capital, digit, dot, apostrophe, hyphen or odd
#: blank, one letter only, or consonants only.
_REWRITABLE = rf"[A-Z\p{{Nd}}.'\-\p{{Z}}\x09-\x0d\x1c-\x1f\x85]|^.?$|^[{_CONSONANTS}]{{2,}}$"


def new_rules(counts: DataFrame, vocab: DataFrame, lexicon: DataFrame, p: Protection = Protection()) -> DataFrame:
    """src, dst: rewrites of words out of vocabulary, one pass.

    The lookups of the rewriting are joins, each for the words that need it alone: parts
    beside a hyphen for words with one, classes and parts beside an apostrophe for words
    with one.  Words that are targets of this pass's rules are left for the next.
    """
    one = unigrams(counts).where("c > 0")
    oov = out_of_vocabulary(one, vocab).where(F.col("ngram").rlike(_REWRITABLE))
    dashed, quoted = F.contains("ngram", F.lit("-")), F.contains("ngram", F.lit("'"))
    a, b = F.regexp_extract("ngram", "^(.*?)-(.*)$", 1), F.regexp_extract("ngram", "^(.*?)-(.*)$", 2)
    pot = potentials(counts.where(dashed))  # a part with a hyphen stems from a word with one
    beside = oov.where(dashed).select("ngram", F.concat(a, F.lit("-")).alias("left_key"), F.concat(F.lit("-"), b).alias("right_key"), F.lower(a).alias("head"), b.alias("tail"))
    beside = beside.join(pot.select(F.col("part").alias("left_key"), F.col("c").alias("left")), "left_key", "left")
    beside = beside.join(pot.select(F.col("part").alias("right_key"), F.col("c").alias("right")), "right_key", "left")
    words = lexicon.select("word").distinct()
    beside = beside.join(words.select(F.col("word").alias("head"), F.lit(True).alias("has_head")), "head", "left")
    beside = beside.join(words.select(F.col("word").alias("tail"), F.lit(True).alias("has_tail")), "tail", "left")
    beside = beside.select("ngram", "left", "right", "has_head", "has_tail")
    inside = oov.where(quoted)
    mine = inside.select(project_apostrophe(F.col("ngram")).alias("p")).distinct()
    kin = unigrams(counts).withColumn("p", project_apostrophe(F.col("ngram"))).join(mine, "p", "left_semi").select("ngram", "c")
    best = best_members(kin, "apostrophe").where(quoted).withColumnRenamed("best", "best_apostrophe")
    la, lb = F.regexp_extract("ngram", "^(.*)'(.*)$", 1), F.regexp_extract("ngram", "^(.*)'(.*)$", 2)
    keys = F.array(la, F.concat(la, F.lit("'")), lb, F.concat(F.lit("'"), lb))
    parts = inside.select("ngram", F.explode(keys).alias("k")).distinct()
    near = one.join(parts.select(F.col("k").alias("ngram")).distinct(), "ngram", "left_semi")
    seen = flagged(near, vocab).select(F.col("ngram").alias("k"), F.col("c").alias("n"), "iv")
    found = parts.join(seen, "k").groupBy("ngram").agg(F.collect_list(F.struct("k", "n", "iv")).alias("parts"))
    look = oov.join(beside, "ngram", "left").join(best, "ngram", "left").join(found, "ngram", "left")

    @F.pandas_udf("string")
    def rewrite(frame):
        import pandas as pd

        out = []
        for r in frame.itertuples(index=False):
            got = list(r.parts) if r.parts is not None else []
            x = {
                "left": None if pd.isna(r.left) else r.left,
                "right": None if pd.isna(r.right) else r.right,
                "head_in_lexicon": r.both is True or r.both == True,  # noqa: E712
                "best_apostrophe": None if pd.isna(r.best_apostrophe) else r.best_apostrophe,
                "known": {g["k"]: bool(g["iv"]) for g in got},
                "count": {g["k"]: int(g["n"]) for g in got},
            }
            out.append(" ".join(transform_oov(r.ngram, x, p).split()))
        return pd.Series(out, dtype="object")

    both = (F.coalesce("has_head", F.lit(False)) & F.coalesce("has_tail", F.lit(False))).alias("both")
    ready = look.select("ngram", "c", F.struct("ngram", "left", "right", both, "best_apostrophe", "parts").alias("x"))
    rules = ready.select(F.col("ngram").alias("src"), rewrite("x").alias("dst")).where("src <> dst AND dst <> ''")
    return rules


def without_conflicts(rules: DataFrame) -> DataFrame:
    """Rules whose source no rule of the same pass produces, whole or as a token."""
    made = rules.select(F.explode(F.array_union(F.split("dst", " "), F.array("dst"))).alias("src")).distinct()
    return rules.join(made, "src", "left_anti")


def compose(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rules with their targets rewritten token by token by the new ones, and the
    new ones, which win where both have a source."""
    tokens = old.select("src", F.posexplode(F.split("dst", " ")).alias("place", "token"))
    mapped = tokens.join(new.select(F.col("src").alias("token"), F.col("dst").alias("to")), "token", "left")
    again = (
        mapped.groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("to", "token").alias("w")))).alias("ws"))
        .select("src", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("dst"))
    )
    return again.join(new.select("src"), "src", "left_anti").unionByName(new.select("src", "dst"))


def move_counts(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts of sources moved to their targets.

    A target of several words takes the count itself, and each of its words takes
    it too.  Where a bigram turns into a bigram, each changed word hands on its
    share: the whole part of its count times the bigram's over its count in bigrams.
    """
    hit = rules.join(counts.select(F.col("ngram").alias("src"), "c"), "src").where("c > 0")
    both = F.contains("src", F.lit(" ")) & F.contains("dst", F.lit(" "))
    multi = F.contains("dst", F.lit(" ")) & ~F.contains("src", F.lit(" "))
    whole = hit.select(F.explode(F.array(F.struct(F.col("src").alias("ngram"), (-F.col("c")).alias("d")), F.struct(F.col("dst").alias("ngram"), F.col("c").alias("d")))).alias("x")).select("x.*")
    spread = hit.where(multi).select(F.explode(F.split("dst", " ")).alias("ngram"), F.col("c").alias("d"))
    pairs = hit.where(both).select(F.explode(F.arrays_zip(F.split("src", " ").alias("a"), F.split("dst", " ").alias("b"))).alias("x"), "c")
    pairs = pairs.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), "c").where("a <> b")
    own = counts.select(F.col("ngram").alias("a"), F.col("c").alias("own"))
    inside = in_bigrams(counts).select(F.col("ngram").alias("a"), F.col("c").alias("inside"))
    share = pairs.join(own, "a").join(inside, "a").withColumn("d", F.floor(F.col("own") * F.col("c") / F.col("inside")))
    handed = share.select(F.explode(F.array(F.struct(F.col("b").alias("ngram"), F.col("d")), F.struct(F.col("a").alias("ngram"), (-F.col("d")).alias("d")))).alias("x")).select("x.*")
    changes = reduce(DataFrame.unionByName, [whole, spread, handed])
    return (
        counts.select("ngram", F.col("c").alias("d"))
        .unionByName(changes)
        .groupBy("ngram")
        .agg(F.sum("d").cast("long").alias("c"))
        .where("c > 0")
    )


def recased_bigrams(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """src, dst: bigrams with an unknown word whose best re-cased form counts over five times theirs.

    The first letter of an unknown word may change its case; words of the
    vocabulary stay.  Forms of a bigram meet by their words with small first letters;
    as every count is positive, only bigrams that count over five can be such a form,
    so all bigrams are shuffled once, and the vocabulary, which its size bounds, is broadcast.
    """
    shape = r"^([A-Za-z])([^ \-']+) ([A-Za-z])([^ \-']+)$"
    pairs = counts.where(F.col("ngram").rlike(shape)).select("ngram", "c", F.split("ngram", " ").alias("w"))

    def small(c: Column) -> Column:
        return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))

    pairs = pairs.select("ngram", "c", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    pairs = pairs.withColumn("key", F.concat_ws(" ", small(F.col("a")), small(F.col("b"))))
    forms = pairs.where("c > 5").select("key", F.col("ngram").alias("dst"), F.col("c").alias("n"), F.col("a").alias("x"), F.col("b").alias("y"))
    known = vocab.select("ngram")
    pairs = pairs.join(F.broadcast(known.select(F.col("ngram").alias("a"), F.lit(True).alias("ka"))), "a", "left")
    pairs = pairs.join(F.broadcast(known.select(F.col("ngram").alias("b"), F.lit(True).alias("kb"))), "b", "left")
    pairs = pairs.where("ka IS NULL OR kb IS NULL")
    better = pairs.join(forms, "key").where("n > 5 * c AND (ka IS NULL OR x = a) AND (kb IS NULL OR y = b)")
    best = better.groupBy("ngram").agg(F.max(F.struct("n", "dst")).alias("top"))
    return best.where("top.dst <> ngram").select(F.col("ngram").alias("src"), F.col("top.dst").alias("dst"))


def same_vocabulary(a: DataFrame, b: DataFrame) -> bool:
    """Equal words at equal ranks."""
    return not a.select("rank", "ngram").exceptAll(b.select("rank", "ngram")).limit(1).count() and a.count() == b.count()


def _state(counts: DataFrame) -> tuple:
    """Equal for equal counts, in any order; two 64-bit sums of hashes else."""
    row = [F.sum(F.xxhash64("ngram", "c", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    return tuple(counts.agg(F.count(F.lit(1)).alias("n"), *row).first())


def _unseen(counts: DataFrame, seen: set[tuple]) -> None:
    state = _state(counts)
    if state in seen:
        raise RuntimeError("the rules go round in a cycle: counts are those of an earlier pass")
    seen.add(state)


def minimise_oov(
    spark: SparkSession,
    counts: DataFrame,
    size: int,
    lexicon: DataFrame,
    protection: Protection = Protection(),
    bigrams: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rules (src, dst) and counts after passes over unknown words until none is new,
    then over bigrams until the vocabulary is stable.

    Counts that come back as they were in an earlier pass would go round for ever;
    they raise an error.  The passes over words never look at bigrams, so these stay
    aside in a table of their own, and n-grams that become several words join them at the end.
    """
    counts = checkpointed(counts)
    pairs = counts.where(F.contains("ngram", F.lit(" ")))
    counts = checkpointed(unigrams(counts))
    seen = {_state(counts)}
    rules = spark.createDataFrame([], "src string, dst string")
    gained: list[DataFrame] = []
    while True:
        vocab = checkpointed(vocabulary(counts, size))
        new = checkpointed(without_conflicts(new_rules(counts, vocab, lexicon, protection)))
        if not new.limit(1).count():
            break
        rules = checkpointed(compose(rules, new))
        moved = checkpointed(move_counts(counts, new))
        gained.append(moved.where(F.contains("ngram", F.lit(" "))))
        counts = unigrams(moved)
        _unseen(counts, seen)
    added = reduce(DataFrame.unionByName, gained, pairs)
    counts = checkpointed(counts.unionByName(added.groupBy("ngram").agg(F.sum("c").cast("long").alias("c")).where("c > 0") if gained else pairs))
    if bigrams:
        seen = {_state(counts)}
        words = checkpointed(ranked_vocabulary(counts, size))
        while True:
            new = checkpointed(without_conflicts(recased_bigrams(counts, words)))
            if not new.limit(1).count():
                break
            rules = checkpointed(compose(rules, new))
            counts = checkpointed(move_counts(counts, new))
            after = checkpointed(ranked_vocabulary(counts, size))
            if same_vocabulary(after, words):
                break
            _unseen(counts, seen)
            words = after
    return rules, counts


def printable(rules: DataFrame, protection: Protection = Protection()) -> DataFrame:
    """line: rules worth keeping as ``src => dst``, marks escaped."""
    letters = F.length(F.regexp_replace("src", "[^A-Za-z0-9]", ""))
    kept = rules.where(
        (F.col("src") != F.col("dst"))
        & (F.col("src") != "")
        & (F.col("dst") != "")
        & ~F.contains("src", F.lit(","))
        & ~F.col("src").rlike(r"\(.*\)")
        & ~F.col("dst").rlike(r"\(.*\)")
        & (letters < 21)
        & ~F.col("src").rlike(" .* .* ")
    )
    src, dst = F.regexp_replace("src", r"([.?*+])", r"\\$1"), F.col("dst")
    if protection.uppercase:
        src, dst = F.upper(src), F.upper(dst)
    return kept.select(F.concat_ws(" => ", src, dst).alias("line"))
