"""A preset crosses to Python once."""

import pytest
from textloom.operators.specific import PRESETS
from textloom.plans.normalise import normalised


@pytest.mark.parametrize("preset", sorted(PRESETS))
@pytest.mark.parametrize("lang", ["en", "fr"])
def test_one_function_a_preset(spark, preset, lang):
    docs = spark.createDataFrame([("The F.B.I. colour of 12-15 cats, NATO-led .",), (None,)], "text string")
    plan = normalised(docs, preset, lang=lang)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
