"""Operators 5 and 6: exact round trips and brute-force attribution."""

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import token_binary, token_counts
from textloom.llm.tokenizer import DEFAULT_TOKENIZER, Tokenizer, tokenizer

TEXTS = [
    "Hello world, it's 3 o'clock.",
    "  leading and  double   blanks \n and tails ",
    "line one\nline two\n\n\nline five",
    "tab\tand \t mixed\r\n",
    "naïve café — 文字 😀😀 ½²",
    "",
    None,
    " ",
    "a " * 5000,
    "<|endoftext|> is ordinary text",
    "x y 　z",
]


def test_words_in_memory_give_the_tokenizers_ids():
    codec = Tokenizer(DEFAULT_TOKENIZER)
    for _ in range(2):
        ids, at = codec.encode_rows(pa.array(TEXTS))
        for k, t in enumerate(TEXTS):
            assert ids[at[k] : at[k + 1]].tolist() == codec.encode(t or "")


def test_random_texts_encode_alike():
    rng = np.random.default_rng(8)
    alphabet = list("ab  \n\t.,'s1é") + [" ", " ", "字"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)]
    codec = Tokenizer(DEFAULT_TOKENIZER, memory=500)
    ids, at = codec.encode_rows(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == codec.encode(t)


def test_files_give_back_every_text(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    docs = documents.repartition(3)
    from textloom.llm.common import saved

    docs = saved(docs)
    index = token_binary.write_tokens(docs, folder).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(index.doc_id) == sorted(texts)
    codec = tokenizer(DEFAULT_TOKENIZER)
    base = 0
    for part, rows in index.groupby("part"):
        f = token_binary.TokenFile(folder, part, codec.dtype)
        rows = rows.sort_values(["start", "n_tokens"])
        assert len(f) == len(rows)
        assert int(rows.start.min()) == base
        for _, r in rows.iterrows():
            lo = int(r.start) - base
            assert codec.decode(f.ids[lo : lo + int(r.n_tokens)]) == texts[r.doc_id]
        assert np.diff(f.offsets).sum() == rows.n_tokens.sum()
        base += int(rows.n_tokens.sum())
    assert base == index.n_tokens.sum()
    assert not list((tmp_path / "tokens").glob("_tmp*"))


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    index = token_binary.write_tokens(odd, f"file://{tmp_path}/odd").toPandas()
    assert len(index) == odd.count()
    assert (index[index.doc_id.isin([2, 3])].n_tokens == 0).all()
    assert token_binary.write_tokens(empty, f"file://{tmp_path}/none").count() == 0


def brute_sections(text, rule):
    codec = tokenizer(DEFAULT_TOKENIZER)
    raw = text.encode()
    ends, total = [], 0
    for line in raw.split(b"\n"):
        total += len(line) + 1
        ends.append(total)
    if raw.endswith(b"\n"):
        ends.pop()
    ends[-1] = len(raw)
    counts = [0] * len(ends)
    owner = [next(k for k, e in enumerate(ends) if b < e) for b in range(len(raw))]
    at = 0
    for i in codec.encode(text):
        n = int(codec.bytes_of[i])
        mine = owner[at : at + n]
        if rule == "first":
            counts[mine[0]] += 1
        elif rule == "last":
            counts[mine[-1]] += 1
        else:
            counts[max(sorted(set(mine)), key=lambda s: (mine.count(s), -s))] += 1
        at += n
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_match_brute_force(spark, documents, rule):
    texts = [(k, t) for k, t in enumerate(t for t in TEXTS if t)] + [(100, "a\n\n\n\nb\n \n  c\n"), (101, "\n")]
    texts += [(1000 + r["doc_id"], r["text"]) for r in documents.collect()[:40]]
    got = token_counts.count_sections(spark.createDataFrame(texts, "doc_id long, text string"), rule).toPandas()
    for k, t in texts:
        rows = got[got.doc_id == k].sort_values("section")
        assert rows.n_tokens.tolist() == brute_sections(t, rule)
        assert "".join(t[a:b] for a, b in zip(rows.start_char, rows.end_char)) == t


def test_section_counts_of_odd_rows(spark, odd, empty):
    got = token_counts.count_sections(odd).toPandas()
    assert set(got.doc_id.dropna()) == {1, 4, 5, 6, 7}
    assert len(got[got.doc_id == 1]) == 2
    assert token_counts.count_sections(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_sections(odd, "other")


def test_memory_of_words_is_bounded():
    small = Tokenizer(DEFAULT_TOKENIZER, memory=50)
    for k in range(20):
        texts = [f"word{k} and number {k * 7}", f"two  blanks {k} at the end  " * 20, None, ""]
        ids, bounds = small.encode_rows(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [small.encode(t) if t else [] for t in texts]
        assert small.words.held <= 5 * 50 + len(ids)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a1", "one two\nthree"), (None, "x"), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in token_binary.write_tokens(docs).collect()} == {"a1", "b", None}
    assert {r["doc_id"] for r in token_counts.count_sections(docs).collect()} == {"a1", None}


def test_odd_spaces_and_marks_encode_alike():
    """Learned words against the tokenizer itself, where a word may begin, end or hold anything."""
    t = Tokenizer(DEFAULT_TOKENIZER)
    texts = [" leading", "a\0b c", "two  spaces", "ends ", "\n", " ", "a\nb c\n\n d", "été 文字\u3000x y", "tab\t z", None, "", "x" * 5000 + " y", "same same", " \n x", "\r\n a", "\0"]
    for _ in range(2):
        ids, bounds = t.encode_rows(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == (t.encode(text) if text else []), text
