"""Ids and texts against the tokenizers library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@pytest.fixture
def whole():
    return LIBRARY


@pytest.fixture
def small_chunks(monkeypatch):
    """Cuts every few bytes, so that any place may be one."""
    monkeypatch.setattr(bpe, "LEAST", 3)
    monkeypatch.setattr(bpe, "MOST", 40)
    monkeypatch.setattr(bpe, "_CUTS_BELOW", np.uint32(1 << 29))


def ids(text):
    return np.frombuffer(bpe.codec(PATH).encode(text.encode()), "<u4").tolist()


TEXT = st.one_of(
    st.text(alphabet=st.one_of(st.sampled_from(list("abZé's \n\t,.!1²µªßÀ\x85\xa0\x1c\x1f|<>İΣ́漢 ​﻿’ \x00")), st.characters(codec="utf-8")), max_size=200),
    st.lists(st.sampled_from(["'s", "'re", " ", "  ", "\n", " the", "word", "don't", "<|endoftext|>", "123", " 7", "...", "é", "漢字", "　", "I'LL", "'", "x" * 30]), max_size=60).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_joins_anywhere(text):
    codec = bpe.codec(PATH)
    raw = text.encode()
    if b"<|endoftext|>" not in raw:
        edges = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        for step in (1, 2, 5, 9):
            ends = [*edges[::step], len(raw)] if raw else []
            if ends:
                assert np.frombuffer(codec.joined(raw, ends), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_small_chunks(whole, small_chunks):
    for text in ("It's the dog's, they'll say: don't   \n\n go.  " * 40, "x" * 5000, "漢字" * 900 + " and more", " " * 3000 + "a", "é'é'é " * 500, "<|endoftext|>a<|endoftext|><|endoftext|> b" * 9):
        assert ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_chunks_are_reused():
    rng = np.random.default_rng(5)
    passage = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(4000))
    codec = bpe.Codec(PATH)
    codec.encode(passage.encode())
    first = codec.encoded
    codec.encode(("Other words before it, " * 7 + passage + " and behind.").encode())
    assert first > 10 and codec.encoded - first <= 4 and codec.reused >= first - 3


def test_bytes_of_every_id(whole):
    codec = bpe.codec(PATH)
    for i in range(0, 50_257, 7):
        assert codec.decode(np.array([i])) == whole.decode([i], skip_special_tokens=False)
    rng = np.random.default_rng(3)
    for _ in range(200):
        some = rng.integers(0, 50_257, 20)
        assert codec.decode(some) == whole.decode(some.tolist(), skip_special_tokens=False)
    assert codec.decode(np.array([1, 99_999_999, -4, 2])) == whole.decode([1, 2], skip_special_tokens=False)


def test_rows(spark, whole):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "The cat's. ", 0), (2, None, 1), (3, "", 2), (3, "", 2), (None, "no id", 3), (4, long, 4), (5, "z" * 100_000, 5), (6, "a<|endoftext|> b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = bpe.encode(docs, PATH)
    got = sorted((str(r.doc_id), r.ids) for r in coded.collect())
    assert got == sorted((str(d), whole.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(coded, PATH).collect()) == sorted((str(d), t or "") for d, t, _ in rows)
    odd = spark.createDataFrame([(None, "x"), ([], "x"), ([5, None, -1, 10**9], "x")], "ids array<int>, text string")
    assert [r.text for r in bpe.decode(odd, PATH).collect()] == [None, "", whole.decode([5])]
    assert bpe.encode(docs.limit(0), PATH).count() == 0 and bpe.round_trip(docs.limit(0), PATH).count() == 0
    assert bpe.encode(spark.sql("SELECT 1 AS doc_id, cast(X'61FF20C3' AS string) AS text"), PATH).first().ids == whole.encode("a� �", add_special_tokens=False).ids


def test_query(spark, whole):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.QUERIES["op12_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        expected = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = whole.decode(expected, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(expected), hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
