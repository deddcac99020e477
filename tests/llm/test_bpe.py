"""BPE against the tokenizers library, and exact round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

tokenizers = pytest.importorskip("tokenizers")
from veilspark.llm import bpe

PATH = bpe.default_path()
LIB = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(next(bpe.codec(PATH).encode([text])), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert ids(text) == LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a" * 500, "aaab" * 90, " " * 70 + "x", "x<|endoftext|>y<|endoftext|>", "I'll we've it's 's", "a\n\n \t b", "naïve \U0001f600 שלום"])
def test_edges(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.codec(PATH).decode(want) == LIB.decode(want, skip_special_tokens=False) == text


def test_syllables_and_small_cache(monkeypatch):
    for k in ("NEW_WORDS", "USED_WORDS", "PAIRS"):
        monkeypatch.setattr(bpe, k, 50)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["ing", "the", "er", "ver", "un", "able", "ation", " ", "ß"]) for _ in range(25))
        assert ids(t) == LIB.encode(t, add_special_tokens=False).ids


def test_table(docs, no_docs, doc_rows):
    got = bpe.decode(bpe.encode(docs)).select("doc_id", "text", "n_tokens", "decoded").collect()
    assert len(got) == len(doc_rows)
    for r in got:
        assert r.decoded == (r.text or "") and r.n_tokens == len(LIB.encode(r.text or "", add_special_tokens=False).ids)
    assert bpe.digests(no_docs).count() == 0


def test_digests_are_those_of_the_library(docs, doc_rows):
    import hashlib

    want = []
    for i, t, _ in doc_rows:
        x = LIB.encode(t or "", add_special_tokens=False).ids
        back = LIB.decode(x, skip_special_tokens=False)
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_words_are_not_kept():
    c = bpe.Codec(PATH)
    words = [f"{i}" + "é" * 400 for i in range(50)] + ["short"]
    for _ in range(3):
        got = list(c.encode([" ".join(words)]))
    assert np.frombuffer(got[0], "<u4").tolist() == LIB.encode(" ".join(words), add_special_tokens=False).ids
    assert all(len(w) <= bpe.WORD_CHARS for w in [*c.new, *c.used])


def test_clashing_columns_and_a_very_long_text(spark):
    text = "der lange Text " * 60_000 + "x" * 100_000
    df = spark.createDataFrame([(None, text, "a", "b")], "doc_id long, text string, ids string, node string")
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "text", "node", "n_tokens", "ids"]
    r = bpe.decode(out).first()
    assert r.decoded == text and r.node == "b"
