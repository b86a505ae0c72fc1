"""Readers, writers, SSML, streams and whole chains."""

import pytest
from pyspark.sql import functions as F
from textloom.plans import normalise
from textloom.sources import resources, ssml
from textloom.streaming import normalise as streams


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("one\ntwo")
    (tmp_path / "docs/b.md").write_text("three")
    assert [r["text"] for r in resources.read_documents(spark, str(tmp_path / "docs"), "txt").collect()] == ["one\ntwo"]
    assert sorted(r["text"] for r in resources.read_lines(spark, str(tmp_path / "docs")).collect()) == ["one", "three", "two"]
    (tmp_path / "units.lst").write_text("nm, nautical mile\nkm, kilometer\nnm, nanometer\nft, foot, PLURAL=feet\nt, ton, UNRELIABLE\n# none\n")
    units = {u.symbol: u for u in resources.read_units(spark, str(tmp_path / "units.lst"))}
    assert units["nm"].singular == "nanometer" and units["ft"].plural == "feet" and not units["t"].reliable
    (tmp_path / "words").write_text("Paris\nwell_known\tx\n# skip\n")
    lexicon = resources.read_lexicon(spark, str(tmp_path / "words"))
    assert "well known" in lexicon and "NP" in lexicon.tags("Paris")
    (tmp_path / "counts.tsv").write_text('the\t5\n"\t4\nthe dog\t1\nrare\t1\nthe\t2\nthree word gram\t9\n')
    got = {r["ngram"]: r["c"] for r in resources.read_counts(spark, str(tmp_path / "counts.tsv"), 2).collect()}
    assert got == {"the": 7, '"': 4, "the dog": 1}
    (tmp_path / "r.rules").write_text("a => b\n# c\nc => d\n")
    assert [r.pattern for r in resources.read_rules(spark, str(tmp_path / "r.rules"))] == ["a", "c"]


def test_tag_classes(spark, tmp_path):
    from textloom.operators import columns

    df = spark.createDataFrame([("x <DATE> may </DATE> y <URL> a dot b </URL>",)], "text string")
    bodies = df.select(F.explode(columns.tag_bodies(F.col("text"))).alias("b")).select("b.*")
    resources.write_tag_classes(bodies, str(tmp_path / "tags"))
    assert spark.read.text(str(tmp_path / "tags/tag=DATE")).first()[0] == "may"


def test_ssml():
    xml = "<speak><p><s>one <sub alias='two'>2</sub></s></p><s><phoneme ph='h e'>he</phoneme><break time='1.5s'/></s></speak>"
    got = ssml.items(xml)
    assert got == [
        (0, "word", 0, "one", None, None),
        (0, "word", 1, "two", None, None),
        (1, "word", 0, "he", None, None),
        (1, "phoneme", 0, "h", 0, 0),
        (1, "phoneme", 1, "e", 0, 0),
        (1, "filler", 0, "silence", None, None),
        (1, "duration", 0, "1.5", 1, 1),
    ]
    for bad in ("<speak><sub>x</sub></speak>", "<speak><break time='3min'/></speak>", "<speak><phoneme>x</phoneme></speak>"):
        with pytest.raises(ValueError):
            ssml.items(bad)


def test_stream_of_counts(spark, tmp_path):
    rows = [(0, "a b a"), (30, "a"), (90, "b")]
    docs = spark.createDataFrame(rows, "s int, text string").select(F.timestamp_seconds("s").alias("ts"), "text")
    docs.write.parquet(str(tmp_path / "in"))
    source = streams.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string")
    q = streams.count_stream(source, "text", "ts", "1 minute", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"].minute, r["ngram"], r["c"]) for r in spark.table("counted").collect()} == {(0, "a", 3), (0, "b", 1), (1, "b", 1)}


TEXTS = [
    ("en", "In 2011 the organisation paid $5m for 3 km of road, etc.", ["two thousand eleven", "five million dollars", "three kilometers", "et cetera"]),
    ("fr", "Il y a 200 mètres à faire le 21/10/05.", ["deux cents mètres", "vingt et un octobre deux mille cinq"]),
]


@pytest.mark.parametrize("lang,text,parts", TEXTS)
def test_generic_chain_leaves_no_digits(spark, lang, text, parts):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in normalise.generic(df, lang=lang).collect()}
    assert rows[2] is None and rows[3] == ""
    assert not any(c.isdigit() for c in rows[1])
    for part in parts:
        assert part in rows[1]
    tags = [w for w in rows[1].split() if w.startswith("<")]
    assert len(tags) % 2 == 0


@pytest.mark.parametrize("preset", ["asr", "g2p", "indexing", "nlp", "tts"])
def test_presets(spark, preset):
    df = spark.createDataFrame([(1, TEXTS[0][1])], "doc_id long, text string")
    out = normalise.normalised(df, preset).first()["text"]
    assert "<" not in out and out
    if preset in ("asr", "indexing"):
        assert out == out.upper() and "ORGANISATION" in out
    if preset == "g2p":
        assert out == out.lower()


def test_chains_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"On 3/{i + 1}/1999 we saw {i * 7} m of it.") for i in range(20)], "doc_id long, text string")
    one = {tuple(r) for r in normalise.generic(df.repartition(1)).collect()}
    assert one == {tuple(r) for r in normalise.generic(df.repartition(5)).collect()}


def test_speech_has_a_sentence_a_line(spark):
    df = spark.createDataFrame([(1, "We came . They left ?")], "doc_id long, text string")
    assert normalise.speech_text(df).first()["text"].count("\n") == 2


def test_spread_only_where_files_are_few(spark, tmp_path, monkeypatch):
    from textloom import session

    spark.range(1000).selectExpr("id", "repeat('x', 100) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(scan) is scan  # too small
    monkeypatch.setattr(session, "SPREAD_BYTES", 100)
    assert session.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(scan).count() == 1000
    monkeypatch.setattr(session, "ROW_GROUP_BYTES", 1)
    assert session.spread(scan) is scan  # large


FRENCH = {
    "L'équipe d'analyse de l'annexe travaille.": "l' équipe d' analyse de l' annexe travaille .",
    "Qu'elle vienne, c'est l'heure : j'ai d'autres soucis aujourd'hui.": "qu' elle vienne , c' est l' heure : j' ai d' autres soucis aujourd'hui .",
    "Au XXIe siècle, il y a dix ans.": "Au vingt et unième siècle , il y a dix ans .",
    "Le M.P.E.G.4 et l'Airbus A330 volent.": "le M.P.E.G.4 et l' Airbus A.330 volent .",
    "Louis XIV et le XVIIIe siècle (fin).": "Louis quatorzième et le dix-huitième siècle fin .",
    "à la page b de l'annexe A.": "à la page B. de l' annexe A.",
    "le 3e homme et la 2de fois": "le troisième homme et la seconde fois",
}


def test_french_sentences(spark):
    from textloom.plans import normalise

    docs = spark.createDataFrame(list(FRENCH.items()), "raw string, want string").selectExpr("raw AS text", "want")
    for r in normalise.generic(docs, lang="fr").collect():
        assert r["text"] == r["want"]


def test_french_presets(spark):
    from textloom.plans import normalise

    docs = spark.createDataFrame([("Le M.P.E.G.4 d'aujourd'hui, l'I.R.I.S.A. et le XXIe siècle.",)], "text string")
    asr = normalise.normalised(docs, "asr", lang="fr").first()["text"]
    assert asr == "LE M. PEG QUATRE D' AUJOURD'HUI L' IRISA ET LE VINGT ET UNIÈME SIÈCLE"
    said = normalise.speech_text(docs, lang="fr").first()["text"]
    assert "d' aujourd'hui" in said and "D." not in said and "vingt et unième siècle" in said
    grey = spark.createDataFrame([("le program color",)], "text string")
    assert normalise.normalised(grey, ["SPELLING_BRITISH"], lang="fr").first()["text"] == "le program color"


def test_example_pairs(spark):
    """End-to-end wording of two paragraphs, up to named rule data that isn't built in."""
    from textloom.plans import normalise

    raw = (
        "Ces activités concernent en particulier la compression d'images et de vidéos, tant en recherche fondamentale qu'une activité en standardisation.",
        "L'équipe a fêté en octobre 2005 (le 21/10/05), à 08h40, ses 30 ans et comprend environ 530 personnes, dont environ 400 chercheurs, dont 180 doctorants et 90 ingénieurs.",
    )
    want = (
        "ces activités concernent en particulier la compression d' images et de vidéos , tant en recherche fondamentale qu' une activité en standardisation .",
        "l' équipe a fêté en <DATE> octobre deux mille cinq </DATE> le <DATE> vingt et un octobre deux mille cinq </DATE> , à <TIME> neuf heures moins vingt </TIME> , ses trente ans et comprend environ cinq cent trente personnes , dont environ quatre cents chercheurs , dont cent quatre-vingts doctorants et quatre-vingt-dix ingénieurs .",
    )
    docs = spark.createDataFrame(list(enumerate(raw)), "id int, text string")
    got = {r["id"]: r["text"] for r in normalise.generic(docs, lang="fr").collect()}
    assert got == dict(enumerate(want))


def test_halves_of_the_day_with_seconds():
    from textloom.functions import english, french

    assert "in the afternoon" in english.time("3", "45", "20", "pm") and "in the morning" in english.time("3", "45", "20", "am")
    assert "du matin" in french.time("3", "45", "20", "am")


def test_mirrored_files(spark, tmp_path):
    from textloom.sources import resources

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "deep" / "b.c.txt").write_text("été")
    docs = resources.read_documents(spark, str(tmp_path / "in"), "txt")
    out = resources.write_mirrored(docs, "path", "text", str(tmp_path / "in"), str(tmp_path / "out"), "norm")
    assert {r["bytes"] for r in out.collect()} == {7, 5}
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a.norm": "one\ntwo", "deep/b.c.norm": "été"}
    with pytest.raises(Exception, match="not below"):
        resources.write_mirrored(docs, "path", "text", str(tmp_path / "elsewhere"), str(tmp_path / "out2"))


def test_paragraphs_of_presets(spark):
    from textloom.operators.specific import specific

    docs = spark.createDataFrame([("a b\n\n\n\nc",), (None,), ("",)], "text string")
    assert [r["text"] for r in specific(docs, "text", ["HYPHENS_OFF"]).collect()] == ["a b\n\nc", None, ""]
    assert [r["text"] for r in specific(docs, "text", ["HYPHENS_OFF"], keep_paragraphs=True).collect()] == ["a b\n\n\n\nc", None, ""]


def test_tagger_and_name_sets(spark):
    """An entity tagger and several sets of name rules, in order, as inputs of a chain."""
    import dataclasses

    from textloom.operators import rules
    from textloom.plans import normalise

    sets = (rules.RuleSet(rules.parse(["Bill => William"])), rules.RuleSet(rules.parse(["William => Willem"])))
    tagged = dataclasses.replace(normalise.RESOURCES["en"], names=sets, tagger=lambda t: t.replace("Willem", "<PERSON> Willem </PERSON>"))
    docs = spark.createDataFrame([("Yesterday Bill left.",)], "text string")
    assert "<PERSON> Willem </PERSON> left ." in normalise.generic(docs, resources=tagged).first()["text"]
