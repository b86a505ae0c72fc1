"""Long keys and numerals take no longer than other tokens of their length."""

import time

import pytest
from textloom.functions import cleaning, english
from textloom.functions.lexicon import ENGLISH
from textloom.operators import specific
from textloom.operators.vocabulary import transform_oov

KEY = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"


@pytest.mark.parametrize(
    "step",
    [
        lambda t: cleaning.acronyms(t, ENGLISH),
        specific.acronyms_exploded,
        specific.acronyms_exploded_unless_readable,
        lambda t: transform_oov(t.split('"')[1] + '"', {}),
        lambda t: english.remove_bugs(t + " " + "x" * 40 + "-"),
        lambda t: cleaning.entity_fixes(t + " </PERSON> " + "X" * 40 + "-"),
    ],
)
@pytest.mark.parametrize("key", [KEY, "a" + "1" * 40])
def test_long_keys_are_read_once(step, key):
    began = time.process_time()
    step(f'token = "{key}"!! {key}" and {key}.')
    assert time.process_time() - began < 1
