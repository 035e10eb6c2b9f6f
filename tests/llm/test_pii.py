"""Personal data: patterns against plain regular expressions, the field against exhaustive decoding."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelled_texts import PERSONAL
from tessera.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1@.-+ ()0é٣\n", max_size=40) | st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "256.1.1.1.7", "4111 1111 1111 1111", "+1 (234) 555-0000", " ", "@", "4111111111111111", "x", "."]), max_size=8).map("".join))
def test_patterns_equal_regular_expressions(text):
    assert pii.pattern_spans(text) == brute(text)


def test_long_runs_are_linear():
    text = "a" * 200_000 + "@ " + "1" * 200_000 + " " + "1." * 100_000
    assert len(pii.pattern_spans(text)) > 0


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(6, 4, 5)), rng.normal(size=(5, 5))
    lengths = np.array([1, 2, 3, 4, 4, 2])
    got = pii.viterbi(scores, lengths, moves)
    for i, n in enumerate(lengths):
        value = lambda y: moves[0, y[0]] + sum(scores[i, t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y)) + moves[y[-1], 0]  # noqa: E731, B023
        assert tuple(got[i, :n]) == max(itertools.product(range(5), repeat=int(n)), key=value)


def test_field_on_unseen_sentences(model):
    wrong = total = 0
    for row in pii.labelled_words(300, seed=77):
        scores = model.scores([None, None, *(w for w, _ in row), None, None])
        best = pii.viterbi(scores[None], np.array([len(row)]), model.moves)[0]
        wrong += sum(pii.LABELS[x] != y for x, (_, y) in zip(best, row, strict=True))
        total += len(row)
    assert wrong / total < 0.01


def test_skipping_plain_words_changes_nothing(model):
    assert model.plain_is_outside()
    for row in pii.labelled_words(200, seed=5):
        text = "plain words before " + " ".join(w for w, _ in row) + " and some more plain words after it"
        whole = pii.added_spans([(text, [m.span() for m in re.finditer(r"\S+", text)], model.scores([None, None, *text.split(), None, None]))], model)[0]
        parts = [x for found in pii.added_spans([(text, c, s) for c, s in pii.undecided(text, model, False)], model) for x in found]
        assert sorted(whole) == sorted(parts)


def test_rows(spark, model):
    rows = [(1, "mail me: a.b@c.de or call (017) 555-7713 now please", "x"), (2, None, "x"), (3, "", "x"), (3, "no data here at all", "x"), (None, "é 1.2.3.4", "x"), (4, "word " * 50_000 + "4111111111111111", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r.doc_id, len(r.spans)): r for r in pii.find(docs, model).collect()}
    assert [tuple(x) for x in out[1, 2].spans] == [("email", 9, 17), ("phone", 26, 40)] and len(out[1, 2].base) == 1
    assert [tuple(x) for x in out[None, 1].spans] == [("ip", 2, 9)]
    assert out[4, 1].spans[0].kind == "card" and (2, 0) in out and (3, 0) in out
    assert pii.find(docs.limit(0), model).count() == 0


def by_hand():
    """(text, {(kind, start, end)}) of the texts that were marked by hand."""
    for marked in PERSONAL:
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[[a-z]+\])+)\]", marked):
            text += marked[at : m.start()]
            spans.add((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        yield text + marked[at:], spans


def figures(model):
    """(found, wrong, missed) for each kind: spans that touch a marked one of their kind, others, and marked ones without any."""
    out = {k: [0, 0, 0] for k in pii.KINDS}
    for text, marked in by_hand():
        base = pii.pattern_spans(text)
        chains = [(text, c, s) for c, s in pii.undecided(text, model, False)]
        more = [x for found in pii.added_spans(chains, model) for x in found if all(x[2] <= s or e <= x[1] for _, s, e in base)]
        got = {(pii.KINDS[k], s, e) for k, s, e in [*base, *more]}
        touch = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        for k in pii.KINDS:
            out[k][0] += sum(any(touch(x, y) for y in got) for x in marked if x[0] == k)
            out[k][1] += sum(not any(touch(x, y) for x in marked) for y in got if y[0] == k)
            out[k][2] += sum(not any(touch(x, y) for y in got) for x in marked if x[0] == k)
    return out


def test_texts_marked_by_hand(model):
    """The figures in the README."""
    found = figures(model)
    print(found)
    for k, (good, wrong, missed) in found.items():
        assert good / (good + missed) >= 0.8, (k, found)
        assert good / max(1, good + wrong) >= 0.8, (k, found)
