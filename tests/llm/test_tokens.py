"""Ids against two public libraries, and exact round trips."""

import base64

import pytest
from codeloom.llm import tokens as tk

TEXTS = [
    "", None, " ", "\n\n\n", "Hello, world!", "  leading and trailing  ", "don't WE'LL 'S they've", "a" * 5_000, "1" * 999 + "x", "<|endoftext|> is text", "\x00\x01\x7f", "é" * 300, "é 　 ​ 漢字",
    "\U0001f680" * 40 + " \r\n\t", "def f(x):\r\n\treturn x  # ok", "مرحبا नमस्ते", "x" + " " * 200 + "y", "﻿bom", " nbsp", "mixedCASE_and_123.45e-6",
]


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(tk.BYTE_BPE_50K)


def test_same_ids_as_public_libraries(encoder):
    import tiktoken
    from tokenizers import Tokenizer

    h = Tokenizer.from_file(tk.BYTE_BPE_50K.replace(".tiktoken", ".json"))
    h.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.BYTE_BPE_50K, "rb"))}
    t = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = encoder.encode(TEXTS)
    assert got == [h.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    assert got == [t.encode_ordinary(x or "") for x in TEXTS]
    assert [encoder.decode(i) for i in got] == [x or "" for x in TEXTS]


def test_random_texts_round_trip(encoder):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
    def check(t):
        assert encoder.decode(encoder.encode([t])[0]) == t

    check()


def test_small_cache_changes_nothing(encoder, monkeypatch):
    want = encoder.encode(TEXTS)
    monkeypatch.setattr(tk, "_CACHE", 3)
    assert [encoder.encode([t])[0] for t in TEXTS] == want


def test_corpus(spark, encoder):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(0, "again", "x", "y"), (None, "no id", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in tk.encode_corpus(df).collect())
    assert got == sorted((i if i is not None else -1, encoder.encode([t])[0]) for i, t, _, _ in rows)
    counts = tk.token_counts(df).collect()
    assert all(r.exact for r in counts) and sum(r.tokens for r in counts) == sum(len(x) for _, x in got)
    assert tk.encode_corpus(df.limit(0)).count() == 0
    assert tk.encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"


def test_no_text_is_cut_by_batches(spark, encoder):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long), (2, "tail")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in tk.encode_corpus(df).collect()}
    assert encoder.decode(got[1]) == long and encoder.decode(got[2]) == "tail"
