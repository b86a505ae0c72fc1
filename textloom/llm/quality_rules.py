"""Quality rules: hashed word and character n-gram logistic regression trained
on labelled quality rows, probability-calibrated, and scored in Arrow batches
against fixed thresholds.

Defined results.  A null or empty text, or one of white space alone, has no
n-gram: its probability is null and its decision "reject".  Otherwise the
decision is "keep" at or above the upper threshold, "reject" below the lower
one, and "review" between.  Long texts are read whole; repeated rows get a row
each; with no usable label every probability is 0.5, so texts go to review.
Labelled rows are sampled by a seeded hash of their id, rows of equal hashes by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import need
from textloom.llm.linear import Features, Model, labelled_sample, scorer, train

TRAIN_ROWS = 4000
REJECT_BELOW, KEEP_FROM = 0.2, 0.6
FEATURES = Features(bits=20, word_orders=(1, 2), char_orders=(3, 4))


def rules_model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: Features = FEATURES) -> Model:
    """Four fifths of the sample train, the rest calibrates."""
    return train(labelled_sample(docs, labels, "quality", train_rows), features, calibrated=True)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    reject_below: float = REJECT_BELOW,
    keep_from: float = KEEP_FROM,
    model: Model | None = None,
) -> DataFrame:
    """doc_id, calibrated probability and decision of every row."""
    model = model or rules_model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blank = F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True))
    p = F.col("probability")
    return (
        need(docs, "doc_id", "text")
        .withColumn("raw", scorer(lambda: shared.value)(F.col("text")))
        .withColumn("probability", F.when(~blank, F.col("raw")))
        .select(
            "doc_id",
            "probability",
            F.when(p >= keep_from, "keep").when(p >= reject_below, "review").otherwise("reject").alias("decision"),
        )
    )
