"""The rule loop, its cascade, and edge cases of vocabulary analytics."""

import random
import re
from collections import Counter

import pytest
from textloom.operators import vocabulary as v

COUNTS = "ngram string, c long"


@pytest.mark.parametrize(
    "word,x,out",
    [
        ("Well-known", {"head_in_lexicon": True}, "well-known"),
        ("self-made", {"left": 5, "right": 2}, "self- made"),
        ("self-made", {"left": 1, "right": 2}, "self -made"),
        ("edge-", {}, "edge"),
        ("dog's", {}, "dog 's"),
        ("don't", {}, "don't"),
        ("'quoted", {}, "quoted"),
        (".net", {}, "dot net"),
        ("x", {}, "X."),
        ("WORD", {}, "Word"),
        ("bbc", {}, "B.B.C."),
        ("CamelCase", {}, "Camel Case"),
        ("21st", {}, "twenty-first"),
        ("42", {}, "forty two"),
        ("word", {}, "word"),
    ],
)
def test_cascade_for_unknown_words(word, x, out):
    assert v.transform_oov(word, x) == out


def test_protection_keeps_genitives():
    assert v.transform_oov("dog's", {}, v.Protection(saxon=True)) == "dog's"
    assert v.transform_oov("42", {}, v.Protection(uppercase=True)) == "FORTY TWO"


def test_loop_lowers_the_rate(spark):
    rows = [("the", 100), ("dog", 50), ("Camel", 40), ("Case", 30), ("CamelCase", 9), ("dog's", 8), ("'s", 20), ("42", 3), ("the dog", 9), ("The dog", 1), ("The", 1)]
    counts = spark.createDataFrame(rows, COUNTS)
    lexicon = spark.createDataFrame([("dog",)], "word string")
    rules, after = v.minimise_oov(spark, counts, 5, lexicon)
    got = {r["src"]: r["dst"] for r in rules.collect()}
    assert got["CamelCase"] == "Camel Case" and got["dog's"] == "dog 's" and got["The dog"] == "the dog"
    before = v.coverage(counts, v.vocabulary(counts, 5)).first()["oov_rate"]
    assert v.coverage(after, v.vocabulary(after, 5)).first()["oov_rate"] < before
    assert {r["ngram"]: r["c"] for r in after.collect()}["Camel"] == 49


def test_compose_and_conflicts(spark):
    old = spark.createDataFrame([("a", "b c"), ("x", "y")], "src string, dst string")
    new = spark.createDataFrame([("b", "d"), ("x", "z")], "src string, dst string")
    assert {tuple(r) for r in v.compose(old, new).collect()} == {("a", "d c"), ("b", "d"), ("x", "z")}
    clash = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e f")], "src string, dst string")
    assert {r["src"] for r in v.without_conflicts(clash).collect()} == {"a", "d"}


def test_moving_counts_of_bigrams(spark):
    counts = spark.createDataFrame([("The", 10), ("the", 90), ("dog", 30), ("The dog", 4), ("The cat", 4)], COUNTS)
    rules = spark.createDataFrame([("The dog", "the dog")], "src string, dst string")
    after = {r["ngram"]: r["c"] for r in v.move_counts(counts, rules).collect()}
    assert after["the dog"] == 4 and "The dog" not in after
    assert after["The"] == 5 and after["the"] == 95  # 10 * 4 / 8


def test_empty_counts(spark):
    none = spark.createDataFrame([], COUNTS)
    assert v.coverage(none, v.vocabulary(none, 5)).first()["total"] == 0
    assert v.classes(none).count() == v.confusability(none).count() == v.category_report(none, none).count() == 0


def test_vocabulary_breaks_draws_by_the_alphabet(spark):
    counts = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("d", 0), ("a b", 9)], COUNTS)
    assert [(r["ngram"], r["rank"]) for r in v.ranked_vocabulary(counts, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def brute_ways(words):
    """The reference's recursion over words by length, draws by the alphabet."""
    def plain(w):
        w = re.sub("[-'_]", "", re.sub("^([EIei])-", r"\1.", w))
        return re.sub(r"([AOU])\.", r"\1", w).lower()

    h = Counter(map(plain, words))
    real = sorted(h, key=lambda w: (len(w), w))
    letters = {w[i : i + n] for w in real for n in range(2, 10) for i in range(len(w) - n + 1)}
    for w in real:
        if not re.search("[aeiouy.]", w):
            continue
        for i in range(1, len(w)):
            u, v = w[:i], w[i:]
            if u in h and v in real and re.search("[aeiou.]", u) and re.search("[aeiou.]", v):
                h[w] += h[u] * h[v]
        for v in real:
            if re.search("[aeiouy.]", v):
                for glued in (v + w, w + v):
                    if glued not in h and glued in letters:
                        h[glued] = h[v] * h[w]
    return sorted((w, h[plain(w)]) for w in words)


def ways(spark, words):
    rows = v.confusability(spark.createDataFrame([(w,) for w in words], "ngram string")).collect()
    return sorted((r["ngram"], r["variants"]) for r in rows)


def test_splits_into_three_words(spark):
    assert dict(ways(spark, ["an", "on", "anon", "anonan"]))["anonan"] == 3
    assert dict(ways(spark, ["an", "on", "in", "anonin"]))["anonin"] == 2


def test_ways_follow_the_recursion(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aoynt") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"a", "o", "an", "no", "ya", "A.", "a-n", "anan", "noanya"})
    assert ways(spark, words) == brute_ways(words)


def test_loop_goes_on_until_no_rule_is_new(spark, monkeypatch):
    step = lambda c, *_: c.where("c > 0 AND ngram RLIKE '^x+$' AND length(ngram) > 1").selectExpr("ngram AS src", "substring(ngram, 2) AS dst")
    monkeypatch.setattr(v, "new_rules", step)
    counts = spark.createDataFrame([("x" * 24, 3)], COUNTS)
    rules, after = v.minimise_oov(spark, counts, 1, spark.createDataFrame([], "word string"), bigrams=False)
    assert [tuple(r) for r in after.collect()] == [("x", 3)]
    assert {r["dst"] for r in rules.collect()} == {"x"}


def test_loop_reports_a_cycle(spark, monkeypatch):
    swap = lambda c, *_: c.where("ngram IN ('a', 'b')").selectExpr("ngram AS src", "translate(ngram, 'ab', 'ba') AS dst")
    monkeypatch.setattr(v, "new_rules", swap)
    with pytest.raises(RuntimeError, match="cycle"):
        v.minimise_oov(spark, spark.createDataFrame([("a", 3)], COUNTS), 1, spark.createDataFrame([], "word string"), bigrams=False)
