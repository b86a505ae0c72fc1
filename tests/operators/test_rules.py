"""Rule files, the rule engine, options and presets."""

import pytest
from pyspark.sql import functions as F
from textloom.operators import rules, specific


def test_rule_files_skip_what_is_no_rule():
    parsed = rules.parse(["# comment", "", "a => b", "a => c", "x => x", "two words => one", "u[hm]+ => uh # why", " => b", "c => "])
    assert [(r.pattern, r.rewrite.strip(), r.kind) for r in parsed] == [("a", "b", "token"), ("two words", "one", "phrase"), ("u[hm]+", "uh", "regex")]


def test_any_case_adds_forms():
    parsed = rules.parse(["colour => color"], any_case=True)
    assert {(r.pattern, r.rewrite) for r in parsed} == {("colour", "color"), ("Colour", "Color"), ("COLOUR", "COLOR")}


@pytest.mark.parametrize(
    "text,out",
    [
        ("a b", "b b"),
        ("a's b", "b's b"),
        ("xa ax", "xa ax"),
        ("a\na", "b\nb"),
        ("two words here", "one here"),
        ("umm no", "uh no"),
        ("first", "third"),
    ],
)
def test_rules_apply_in_order_at_token_edges(text, out):
    engine = rules.RuleSet(rules.parse(["a => b", "two words => one", "u[hm]+ => uh", "first => second", "second => third"]))
    assert engine.apply(text) == out


def test_later_rules_see_earlier_results_but_not_the_reverse():
    engine = rules.RuleSet(rules.parse(["second => third", "first => second"]))
    assert engine.apply("first") == "second"


def test_mixed_look_behinds_are_split():
    assert rules.RuleSet(rules.parse(["(?<!ab|c)x => y"])).apply("x") == "y"
    assert "[[:alpha:]]" not in rules.translate("[[:alpha:]]+")


def test_token_join_equals_engine(spark):
    parsed = rules.parse(["colour => color", "grey => gray"])
    docs = spark.createDataFrame([(1, "the colour  grey"), (2, "colour's grey' x"), (3, "none"), (4, "")], "doc_id long, text string")
    joined = {r["doc_id"]: r["text"] for r in rules.rewrite_tokens(docs, "text", rules.rules_frame(spark, parsed)).collect()}
    engine = rules.RuleSet(parsed)
    assert joined == {r["doc_id"]: engine.apply(r["text"] + " ")[:-1] for r in docs.collect()}
    applied = {r["doc_id"]: r["text"] for r in rules.apply_rules(docs, "text", engine).collect()}
    assert applied[1] == "the color  gray"


@pytest.mark.parametrize(
    "options,text,out",
    [
        (["TAGS_OFF"], "in <DATE> may </DATE> 's", "in may's"),
        (["TAGS_NO_DATE"], "a <DATE> b </DATE> <TIME> c </TIME>", "a b <TIME> c </TIME>"),
        (["TAG_ON"], "a <DATE> b </DATE>", "a <DATE>"),
        (["PUNCTUATION_OFF", "CASE_LOW"], "Hello , World .", "hello world"),
        (["BREAK_LINES"], "one . two ? ! three", "one .\ntwo ? !\nthree"),
        (["HYPHENS_INTERNAL"], "-a b-c d-", "a b-c d"),
        (["ACRONYMS_JOINT"], "the P.C.A. met", "the PCA met"),
        (["ACRONYMS_EXPLODED"], "the P.C.A. met", "the P. C. A. met"),
        (["LETTER_DOTS_OFF"], "B. here", "B here"),
        (["SAXON_GENITIVES_EXPLODED"], "foo's cars' x", "foo 's cars 's x"),
        (["SPELLING_BRITISH", "CASE_OFF"], "the Color", "THE COLOUR"),
        (["PUNCTUATION_ON", "CASE_ON"], "As is .", "As is ."),
    ],
)
def test_options(spark, options, text, out):
    df = spark.createDataFrame([(text,)], "text string")
    assert specific.specific(df, "text", options).first()["text"] == out


def test_unknown_options_and_aliases():
    with pytest.raises(ValueError):
        specific.known("NO_SUCH_OPTION")
    assert specific.read_config("# c\nTAG_ON\nNO_X_TAG('DATE')\n") == ["TAGS_ON", "TAGS_NO_DATE"]


def test_protected_words_and_scripts(spark):
    df = spark.createDataFrame([("keep-me cut-me",)], "text string")
    assert specific.specific(df, "text", ["HYPHENS_OFF"], vocabulary=[]).first()[0] == "keep me cut me"
    out = specific.specific(df, "text", ["EXTERNAL_SCRIPT=shout"], scripts={"shout": F.upper}).first()[0]
    assert out == "KEEP-ME CUT-ME"


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,), ("a",)], "text string")
    assert [r[0] for r in specific.specific(df, "text", specific.PRESETS["asr"]).collect()] == [None, "A"]


@pytest.mark.parametrize("word,readable", [("NATO", True), ("BBC", False), ("N.A.T.O.", True), ("UNICEF", True), ("UNESCO", False), ("XYZZY", False), ("AB", False), ("LONGERWORD", False)])
def test_readable_acronyms(word, readable):
    assert specific.pronounceable(word) is readable


@pytest.mark.parametrize("limit", [rules.BROADCAST_BYTES, -1])
def test_rewritten_tokens_keep_their_rows(spark, monkeypatch, limit):
    """Repeated keys, null and empty texts, repeated tokens and clashing columns."""
    monkeypatch.setattr(rules, "BROADCAST_BYTES", limit)
    table = rules.rules_frame(spark, rules.parse(["the => THE", "the's => THEIRS", "dog => cat", "cat => dog", "a b => c", "x.* => y"]))
    rows = [(1, "the cat", 0), (1, "a dog", 1), (2, None, 2), (3, "", 3), (1, "the cat", 4), (4, "the's  dog's the' cat'S the the", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row_number int")
    got = {r["row_number"]: r["text"] for r in rules.rewrite_tokens(docs, "text", table).collect()}
    assert got == {0: "THE dog", 1: "a cat", 2: None, 3: "", 4: "THE dog", 5: "THEIRS  cat's THE' dog'S THE THE"}
    assert rules.rewrite_tokens(docs.limit(0), "text", table).count() == 0


def test_what_stands_before_the_mark_stays():
    r = rules.RuleSet(rules.parse([r"[a-zA-Z]\K\+ =>  plus", r"C\K\+\+ => plus plus"]))
    assert r.apply("a+ and b+") == "a plus and b plus"
    assert rules.RuleSet(rules.parse([r"C\K\+\+ => plus plus"])).apply("in C++ and D++") == "in Cplus plus and D++"
    assert r.apply_whole("a+") == "a plus"


def test_a_rule_that_cannot_be_translated_names_its_line():
    with pytest.raises(ValueError, match="line 3"):
        rules.parse(["a => b", "# comment", "(unclosed => c"])
    with pytest.raises(ValueError, match="line 1"):
        rules.parse([r"(a)\K\1 => c"])


def test_ten_thousand_rules_from_a_file(spark, tmp_path):
    """A file of the size of large rule sets, literal and regular rules mixed, against a plain loop."""
    from textloom.sources import resources

    lines = ["# rules", ""]
    lines += [f"word{k} => said{k}" for k in range(8000)]
    lines += [f"two words{k} => joined{k}" for k in range(1500)]
    lines += [f"pre{k}(?:x|y) => post{k}" for k in range(500)]
    (tmp_path / "large.rules").write_text("\n".join(lines))
    found = resources.read_rules(spark, str(tmp_path / "large.rules"))
    assert len(found) == 10_000
    texts = [f"word{k} and two words{k % 1500} or pre{k % 500}x word{k}'s end" for k in range(0, 8000, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in rules.apply_rules(docs, "text", rules.RuleSet(found)).collect()}
    for n, k in enumerate(range(0, 8000, 400)):
        assert got[n] == f"said{k} and joined{k % 1500} or post{k % 500} said{k}'s end"


def test_named_rule_sets():
    book = rules.RuleBook()
    book.load("a", ["x => y", "p => q"])
    book.load("a", ["y => z", "x => no"])
    assert [r.place for r in book.sets["a"].rules] == [0, 1, 2]
    assert book.apply("x p", "a", "none") == "z q"
    book.load("b", ["z => end"])
    assert book.apply("x", "a", "b") == "end" and book.apply("x", "b", "a") == "z"
    book.reset("a")
    assert book.apply("x z", "a", "b") == "x end"
    book.reset()
    assert book.apply("x z", "a", "b") == "x z"
