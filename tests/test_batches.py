"""Batches of a running sequence against a loop over all rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import batches


def plain(tokens, most_tokens, most_items):
    out, batch, n, total = [], 0, 0, 0
    for t in tokens:
        if n and (total + t > most_tokens or n >= most_items):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + t
        out.append(batch)
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 15), st.integers(1, 6), st.integers(1, 9))
def test_composition(tokens, most_tokens, most_items, size):
    n = total = number = 0
    out = []
    for i in range(0, len(tokens), size):
        t = np.array(tokens[i : i + size])
        s = batches.first_start(t[:most_items], n, total, most_tokens, most_items)
        begun, last = batches.reduced(t, most_tokens, most_items)
        after, begins, at = batches.next_starts(t, most_tokens, most_items), np.zeros(len(t), int), s
        while at < len(t):
            begins[at], at = 1, int(after[at])
        out += (number - 1 + np.cumsum(begins)).tolist()
        if s >= len(t):
            n, total = n + len(t), total + int(t.sum())
        else:
            n, total, number = len(t) - int(last[s]), int(t[last[s] :].sum()), number + int(begun[s])
            assert begun[s] == begins.sum()
    assert out == plain(tokens, most_tokens, most_items)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_rows(spark, group):
    rng = np.random.default_rng(3)
    rows = [(["a", None, "b"][min(i % 7, 2)], i, None if i % 11 == 5 else int(rng.integers(0, 300)), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n long, t int, batch string").repartition(5)
    expected = []
    for key in {r[0] for r in rows} if group else [...]:
        own = [r for r in rows if key is ... or r[0] == key]
        expected += [(*(r[0],) * len(group), r[1], b) for r, b in zip(own, plain([r[2] or 0 for r in own], 1000, 9), strict=True)]
    got = batches.batch_pack(df, group, "n", "t", 1000, 9, block_rows=64)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert batches.batch_pack(df.limit(0), group, "n", "t").count() == 0
