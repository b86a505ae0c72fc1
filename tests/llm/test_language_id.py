"""Operator 3 against a plain cross-parser, and held-out accuracy."""

import math

import numpy as np
import pyarrow as pa
from textloom.llm import language_id
from textloom.llm.language_id import Parser, SuffixAutomaton


def plain_phrases(parser, lang, text):
    """Greedy longest matches in the training text, by substring search."""
    train = parser.encode(np.frombuffer(TEXTS[lang].encode("utf-32-le"), np.uint32)).tobytes()
    codes = parser.encode(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tobytes()
    total, start = int(len(codes) > 0), 0
    for i in range(len(codes)):
        if codes[start : i + 1] not in train:
            total += 1
            start = i if codes[i : i + 1] in train else i + 1
    return total


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and runs away from the house\n",
    "fr": "le renard brun saute par dessus le chien paresseux et s'enfuit de la maison\n",
}


def test_phrases_match_a_plain_parser():
    parser = Parser(TEXTS)
    samples = ["the lazy fox", "le chien brun", "zzz 文字 qqq", "x", "the house " * 200, "été à la maison", "brown dog; brown chien"]
    chars = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in samples]
    at = np.concatenate(([0], np.cumsum([len(c) for c in chars])))
    got = parser.phrases(parser.encode(np.concatenate(chars)), at)
    for k, lang in enumerate(parser.languages):
        assert got[:, k].tolist() == [plain_phrases(parser, lang, s) for s in samples]


def test_automaton_holds_exactly_the_substrings():
    codes = [1, 2, 1, 2, 3, 1, 2, 2, 1]
    auto = SuffixAutomaton(codes)
    inside = {tuple(codes[i:j]) for i in range(len(codes)) for j in range(i + 1, len(codes) + 1)}

    def accepts(seq):
        s = 0
        for c in seq:
            if c not in auto.next[s]:
                return False
            s = auto.next[s][c]
        return True

    import itertools

    for n in range(1, 5):
        for seq in itertools.product([1, 2, 3], repeat=n):
            assert accepts(seq) == (seq in inside)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    held = docs.where("doc_id % 2 = 1").toPandas()
    parser = Parser(language_id.training_texts(train))
    langs, bits, lead = parser.identify(pa.array(held.text))
    assert (np.array(langs) == held.lang.to_numpy()).mean() >= 0.97
    assert all(b >= 0 for b in bits) and all(x >= 0 for x in lead)


def test_bits_are_phrases_by_length():
    parser = Parser(TEXTS)
    langs, bits, _ = parser.identify(pa.array(["the quick brown fox"]))
    assert langs == ["en"]
    n = len(parser.encode(np.frombuffer(TEXTS["en"].encode("utf-32-le"), np.uint32)))
    assert math.isclose(bits[0], 1 * math.log2(n) / len("the quick brown fox"))


def test_odd_rows(spark, odd, empty, documents):
    texts = language_id.training_texts(documents)
    out = language_id.identify(odd, texts).toPandas()
    assert len(out) == odd.count()
    assert out[out.doc_id.isin([2, 3, 4])].language.isna().all()
    assert out[out.doc_id == 1].bits.nunique() == 1
    assert language_id.identify(empty, texts).count() == 0
    none = language_id.identify(odd, {}).toPandas()
    assert none.language.isna().all()
    assert set(language_id.training_texts(odd)) == {"en", "de", "fr"}


def test_ties_go_to_the_first_language():
    parser = Parser({"bb": "same text", "aa": "same text"})
    assert parser.identify(pa.array(["same text"]))[0] == ["aa"]


def scripts():
    """Training texts of several scripts, over 62 letters; Greek and Cyrillic words are rare letters' ones."""
    latin = "".join(chr(c) for c in [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0x100)])
    return {"aa": (latin + " ") * 40, "el": "αβγδεζηθ ικλμνξοπ ρστυφχψω", "ru": "абвгдежз ийклмноп рстуфхцч шщъыьэюя", "zh": "".join(chr(0x4E00 + 7 * i) for i in range(400))}


def test_every_letter_has_its_class(monkeypatch):
    parser = Parser(scripts())
    samples = ["ψωαβ βαγ", "щъыь эюя", chr(0x4E00 + 7 * 300) + chr(0x4E00 + 7 * 301), "cdefghij"]
    langs, bits, _ = parser.identify(pa.array(samples))
    assert langs == ["el", "ru", "zh", "aa"]
    monkeypatch.setattr(language_id, "DENSE_BYTES", 0)
    assert Parser(scripts()).identify(pa.array(samples))[:2] == (langs, bits)


def test_rows_without_text_and_long_texts_train(spark):
    rows = [(k, "", "en") for k in range(60)] + [(100, "usable words", "en"), (101, "lang " * 100, "de"), (101, "lang " * 100, "de"), (102, "kurz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = language_id.training_texts(docs, pieces_each=100, piece_chars=20)
    assert texts["en"] == "usable words\n"
    assert sorted(texts["de"].splitlines()) == sorted(["lang " * 4] * 25 + ["kurz"])


def test_pieces_come_from_all_of_a_long_text(spark):
    text = "".join(f"{k:05d}" for k in range(20_000))
    docs = spark.createDataFrame([(1, text, "xx"), (2, "abc", "xx")], "doc_id long, text string, lang string")
    pieces = language_id.training_texts(docs, pieces_each=30, piece_chars=1000)["xx"].splitlines()
    assert len(pieces) == 30 and all(p in text or p == "abc" for p in pieces)
    starts = [text.index(p) for p in pieces if p != "abc"]
    assert max(starts) > 80_000 and min(starts) < 20_000


def test_phrases_match_substring_search_of_raw_text():
    """No class, code or block of the library: Python's ``in`` on the letters themselves."""
    parser = Parser(scripts() | TEXTS)
    every = scripts() | TEXTS
    rng = np.random.default_rng(7)
    for _ in range(40):
        lang = parser.languages[rng.integers(len(parser.languages))]
        letters = [c for c in set("".join(every.values())) | set("ęłß文字") if c.isalpha()] + [" "] * 6
        sample = "".join(every[lang][k : k + 9] if rng.random() < 0.6 else letters[rng.integers(len(letters))] for k in rng.integers(0, len(every[lang]) - 9, 150))
        sample = sample.replace("\n", " ")
        train = {x: every[x].replace("\n", " ") for x in every}
        got = parser.phrases(*coded(parser, [sample]))[0]
        for x, n in zip(parser.languages, got):
            marks = {c for c in train[x] if not c.isalpha()}
            text = "".join(c if c.isalpha() else " " for c in sample)
            clean = "".join(c if c.isalpha() else " " for c in train[x])
            assert n == raw_phrases(clean, text, bool(marks)), (x, sample)


def coded(parser, samples):
    chars = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in samples]
    return parser.encode(np.concatenate(chars)), np.concatenate(([0], np.cumsum([len(c) for c in chars])))


def raw_phrases(train, text, blank_known):
    total, start = 0, 0
    for i, c in enumerate(text):
        if text[start : i + 1] not in train:
            total += 1
            start = i if c in train else i + 1
    return total + 1


SENTENCES = {
    "en": "the river runs through a quiet valley where farmers grow apples and children walk to school every morning with their friends ".split(),
    "ru": "река течёт через тихую долину где крестьяне растят яблоки и дети каждое утро идут в школу вместе с друзьями ".split(),
    "zh": list("河水流过安静的山谷农民在那里种苹果孩子们每天早上和朋友一起走路去学校他们喜欢唱歌读书写字"),
    "ja": list("川は静かな谷を流れ農民はそこでりんごを育て子供たちは毎朝友だちと歩いて学校へ行きます彼らは歌を歌うのが好きです"),
}


def test_four_scripts():
    rng = np.random.default_rng(9)

    def text(lang, n):
        words = SENTENCES[lang]
        at = rng.integers(0, len(words) - 3, n)
        return ("" if lang in ("zh", "ja") else " ").join("".join(words[k : k + 3]) if lang in ("zh", "ja") else " ".join(words[k : k + 3]) for k in at)

    parser = Parser({x: text(x, 60) for x in SENTENCES})
    want = [x for x in SENTENCES for _ in range(50)]
    got = parser.identify(pa.array([text(x, 6) for x in want]))[0]
    assert np.mean([g == w for g, w in zip(got, want)]) >= 0.97


def test_phrases_cross_blocks(monkeypatch):
    parser = Parser(TEXTS)
    samples = ["the house " * 300, "x", "", "le chien brun dog zzz 文 " * 90, TEXTS["en"][:40] * 60]
    chars = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in samples]
    at = np.concatenate(([0], np.cumsum([len(c) for c in chars])))
    codes = parser.encode(np.concatenate(chars))
    want = [[plain_phrases(parser, lang, s) for lang in parser.languages] for s in samples]
    for block in (7, 512):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert parser.phrases(codes, at).tolist() == want
    bits = parser.identify(pa.array(samples[:1]))[1][0]
    assert math.isclose(bits, want[0][0] * parser.bits[0] / len(samples[0]))
