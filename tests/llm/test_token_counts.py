"""Automaton counts against greedy matching by slices."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(pieces, word):
    symbols, at, n = (*word, tc.WORD_END), 0, 0
    longest = max(map(len, pieces), default=0)
    while at < len(symbols):
        size = next((k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in pieces), 0)
        if not size:
            return -1
        n += symbols[at : at + size] != (tc.WORD_END,)
        at += size
    return n


@settings(max_examples=600, deadline=None)
@given(st.sets(st.tuples(st.binary(min_size=0, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), st.booleans()), max_size=14), st.lists(st.binary(max_size=10).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=5))
def test_any_vocabulary(tokens, words):
    pieces = {(*p, *[tc.WORD_END] * end) for p, end in tokens} - {()}
    matcher = tc.LongestMatch(pieces)
    for w in words:
        assert matcher.count(w) == greedy(pieces, w)


def test_public_vocabulary():
    pieces = set(tc.vocabulary(PATH))
    matcher, _ = tc.automaton(PATH)
    for w in "the unbelievable thntiblere été éeauouoi 1234567 &&&the*** x漢字y".split():
        assert matcher.count(w.encode()) == greedy(pieces, w.encode()) > 0


def test_rows(spark):
    rows = [(1, "The the\nTHE", 0), (2, None, 1), (3, "", 1), (3, " \t", 1), (None, "a" * 100_000, 2), (4, "été " * 30_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    pieces = set(tc.vocabulary(PATH))
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in tc.count_tokens(docs, PATH).collect())
    expected = []
    for d, t, _ in rows:
        words = (t or "").encode().lower().split()
        one = {w: greedy(pieces, w) for w in set(words)}
        expected.append((str(d), len(words), sum(one[w] for w in words), 0))
    assert got == sorted(expected)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
