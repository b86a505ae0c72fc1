"""The rule loop looks up no more than it needs, with the same rules."""

import random

import pytest
from pyspark.sql import functions as F
from textloom.operators import vocabulary
from textloom.operators.vocabulary import Protection, transform_oov


@pytest.mark.parametrize("p", [Protection(), Protection(True, True)])
def test_skipped_words_have_no_rewriting(spark, p):
    draw = random.Random(4)
    words = {"".join(draw.choices("aebcyßéÉAB10٣.-'&\u00a0\u2003\x1c+", k=draw.randint(1, 5))) for _ in range(4000)} - {""}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "ngram string")
    skipped = [r.ngram for r in rows.where(~F.col("ngram").rlike(vocabulary._REWRITABLE)).collect()]
    assert len(skipped) > 30
    assert [w for w in skipped if " ".join(transform_oov(w, {}, p).split()) != w] == []


def test_passes_over_words_see_no_bigrams(spark, monkeypatch):
    counts = spark.createDataFrame([("NATO-led", 3), ("won't", 2), ("cats'", 1), ("a b", 9), ("NATO-led cats'", 2), ("a", 50), ("b", 40)], "ngram string, c long")
    lexicon = spark.createDataFrame([("led",)], "word string")
    real, seen = vocabulary.new_rules, []
    monkeypatch.setattr(vocabulary, "new_rules", lambda c, *x: seen.append(c.where("ngram LIKE '% %'").count()) or real(c, *x))
    rules, after = vocabulary.minimise_oov(spark, counts, 2, lexicon)
    assert len(seen) > 1 and not any(seen)
    assert {r.ngram: r.c for r in after.collect()}.items() >= {"a b": 9, "NATO-led cats'": 2}.items()


def test_recasing_broadcasts_the_vocabulary_and_shuffles_bigrams_once(spark):
    counts = spark.range(50).select(F.concat(F.lit("the W"), F.col("id").cast("string")).alias("ngram"), F.lit(1).alias("c")).unionByName(
        spark.createDataFrame([("the w7", 6), ("The W7", 5), ("the w8", 5), ("The w9", 60), ("Odd one", 1), ("odd one", 8), ("Odd One", 7)], "ngram string, c int")
    )
    vocab = spark.createDataFrame([("the", 9)], "ngram string, c long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vocabulary.recased_bigrams(counts, vocab)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.src, r.dst) for r in found.collect()) == [("Odd one", "odd one"), ("the W7", "the w7")]
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
