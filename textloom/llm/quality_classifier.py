"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Defined results.  A null or empty text, or one of white space alone, has no
features: its probability is the bias's and it is rejected as empty.  Very long
texts are read whole.  Repeated rows get equal results, a row each.  With no
usable label every probability is 0.5, which passes.  A row at the threshold
passes.  Columns other than those named are not read.  Labelled rows are sampled
by a seeded hash of their id, rows of equal hashes by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, need
from textloom.llm.linear import Features, Model, labelled_sample, scorer, train

#: Labelled rows that training reads at most, and the least probability kept.
TRAIN_ROWS = 4000
THRESHOLD = 0.5
FEATURES = Features(bits=18, word_orders=(1, 2))


def quality_model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: Features = FEATURES) -> Model:
    return train(labelled_sample(docs, labels, "quality", train_rows), features, calibrated=False)


def _probability(docs: DataFrame, model: Model) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the input
    return scorer(lambda: shared.value)(F.col("text"))


def _accepted(p: Column, threshold: float) -> Column:
    return (p >= threshold) & F.coalesce(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, probability of good quality, and whether the document is accepted."""
    model = model or quality_model(docs, labels)
    scored = need(docs, "doc_id", "text").withColumn("probability", _probability(docs, model))
    return scored.select("doc_id", "probability", _accepted(F.col("probability"), threshold).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the same columns."""
    model = model or quality_model(docs, labels)
    p = fresh(docs, "probability")
    scored = docs.withColumn(p, _probability(docs, model))
    return scored.where(_accepted(F.col(p), threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])
