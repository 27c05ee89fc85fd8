import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrinium.llm import tokens as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{K.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


own = K.codec(K.TOKENIZERS, K.VOCABULARY)
rng = random.Random(4)
HARD = ["", " ", "a", "<|endoftext|> x", "l'x  y\t\tz \n\n ", "x" * 9000, " " * 9000 + "a", "\n" * 5000, "ab" * 20_000, "=-" * 6000 + " z", "àè" * 5000, "".join(rng.choice("abcdefghi") for _ in range(30_000)), "".join(rng.choice("  \n\tab") for _ in range(150_000)), "parola " * 30_000, "日本" * 4000 + "1234567890" * 900]


@pytest.mark.parametrize("k", range(len(HARD)))
def test_hard_texts(k, reference):
    want = reference(HARD[k])
    assert list(own.text(HARD[k])) == want
    assert list(own.tree(HARD[k], 700)) == want or own.runs.search(HARD[k])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    assert list(own.text(text)) == own.plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab' \n\t1\u00a0àlre.s", max_size=300), st.text(alphabet="日本。a ", max_size=300)), st.integers(1, 40))
def test_tree_is_exact_wherever_it_cuts(text, leaf):
    assert list(own.tree(text, leaf)) == own.plain.encode_ordinary(text)


def test_leaves_by_threads(monkeypatch):
    monkeypatch.setattr(K, "THREADED", 1000)
    text = "Il contratto, l'art. 12 e la parola. \n" * 900
    assert list(own.text(text)) == own.plain.encode_ordinary(text)
    assert list(own.text("x" * 20_000)) == own.plain.encode_ordinary("x" * 20_000)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeinrst", min_size=2, max_size=400), st.data())
def test_join_is_exact(text, data):
    piece = text.encode()
    k = data.draw(st.integers(1, len(piece) - 1))
    import numpy as np

    left, right = (np.asarray(own._merge(x), np.int32) for x in (piece[:k], piece[k:]))
    assert list(own.join(left, right)) == own._merge(piece)


def test_table(spark, reference):
    texts = [None, "", "ciao a tutti", "ciao a tutti", "z" * 6000 + " fine " * 900]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in K.encode_corpus(df).collect()}
    assert got == {k: reference(t or "") for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_token for r in K.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert K.encode_corpus(df.limit(0)).count() == 0
    assert K.encode_corpus(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


@pytest.mark.parametrize("gap", ["\n\n", "\n\n\n ", "\u00a0\u00a0", " \n", "  ", " "])
def test_white_space_before_a_long_run(gap, reference):
    for text in (f"foo{gap}" + "x" * 1100, f"{gap}" + "x" * 1100 + f"{gap}" + "7" * 1100 + f"!{gap}", "y" * 1100 + gap + "z" * 5000 + gap):
        assert list(own.text(text)) == reference(text)
