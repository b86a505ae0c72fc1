"""Long runs of digits, products and genitives: no error, and time in proportion to their length."""

import time

import pytest
from textloom.functions import english, french, numbers_en, numbers_fr
from textloom.functions.lexicon import ENGLISH, FRENCH
from textloom.functions.tokens import tokenize
from textloom.operators import specific


@pytest.mark.parametrize("step", [english.end, french.end, lambda t: english.numbers(t, ENGLISH), lambda t: french.numbers(t, FRENCH)])
def test_numbers_of_any_length_are_worded(step):
    said = step("so " + "7" * 5000 + " end")
    assert said.startswith("so ") and said.endswith(" end") and not any(c.isdigit() for c in said[:100])


def test_groups_of_long_numbers():
    assert numbers_en.cardinal("0" * 4999 + "12") == "twelve"
    assert numbers_en.cardinal("1" + "0" * 4400 + "5") == "one times ten to the four thousand four hundred and first and five"
    assert numbers_fr.cardinal("0" * 4999 + "12") == "douze"
    assert numbers_fr.ordinal("0" * 4999 + "12") == "douzième"
    assert numbers_fr.ordinal("12345678901234567892") == numbers_fr.cardinal("12345678901234567892")[:-1] + "ième"
    assert numbers_fr.ordinal("9" * 400).endswith("neuvième")


@pytest.mark.parametrize(
    "step, text",
    [
        (lambda t: english.numbers(t, ENGLISH), "1" * 12_000),
        (english.remove_bugs, "1x" * 12_000),
        (french.remove_bugs, "1x" * 12_000),
        (tokenize, "'s " * 8_000),
        (specific.acronyms_exploded, "a" + "1" * 80_000),
        (specific.acronyms_exploded_unless_readable, "B." * 30_000),
    ],
)
def test_time_is_in_proportion(step, text):
    began = time.process_time()
    step(f"so {text} end")
    assert time.process_time() - began < 1.5
