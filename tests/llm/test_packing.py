"""Packing: every id once, windows within capacity, ids equal to the tokenizer's."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abZé's \n\t,.!1²µªßÀ\x85\xa0\x1c|<>İΣσ́漢")), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_whole_encoding(text):
    raw = packing.encoder(PATH)(text.encode())
    assert np.frombuffer(raw, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_special_strings_and_contractions(whole):
    for text in ("a<|endoftext|>b <|startoftext|>", "it's they'll'd 'tis don't O'Neil's", "x" * 3000, "&&&the*** $$$"):
        assert np.frombuffer(packing.encoder(PATH)(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=120))
def test_windows_hold_each_piece_once(lengths):
    found = packing.windows_for(lengths, 512) if lengths else []
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 512 for w in found)


def test_differencing_is_nearly_even():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 512, 800).tolist()
    loads = [sum(lengths[i] for i in w) for w in packing.difference(lengths, 100)]
    assert len(loads) == 100 and max(loads) - min(loads) <= 40


def test_cuts_cover():
    for n in (0, 1, 511, 512, 2047, 2048, 2049, 9000):
        at = 0
        for s, k in packing.cuts(n):
            assert s == at and 0 < k <= 2048
            at += k
        assert at == n


def test_pack_rows(spark, whole):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, "The cat.", 0), (2, None, 1), (3, "", 2), (3, "", 2), (None, "no id", 3), (4, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack(docs, PATH).collect()
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        ids = np.array(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for doc, text, _ in rows:
        mine = sorted((r.start, tuple(r.ids)) for r in out if r.doc_id == doc)
        copies = sum(d == doc for d, _, _ in rows)
        expected = whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        if copies == 1:
            assert [i for _, ids in mine for i in ids] == expected
        else:
            assert len(mine) == copies
        assert all(r.doc_tokens == len(expected) for r in out if r.doc_id == doc)
    assert packing.pack(docs.limit(0), PATH).count() == 0
