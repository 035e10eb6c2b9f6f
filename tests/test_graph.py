"""Hops and choices against loops."""

import random

import pytest

from tessera.operators import graph, training


def test_reachable(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(1, 1), (1, 2), (1, 2), (None, 3), (4, None)] + [(100, i) for i in range(60)] + [(i, i + 1) for i in range(200, 209)]
    starts = [0, 1, 7, 100, 200, 999, None, 7]
    for most in (None, 2):
        expected = set()
        for s in {x for x in starts if x is not None}:
            depth, front = {s: 0}, [s]
            while front and (most is None or depth[front[0]] < most):
                found = []
                for a in front:
                    for x, y in edges:
                        if x == a and y is not None and y not in depth:
                            depth[y] = depth[a] + 1
                            found.append(y)
                front = found
            expected |= {(s, n, d) for n, d in depth.items()}
        got = graph.reachable(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(s,) for s in starts], "start long"), most)
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == expected and len(rows) == len(expected)


@pytest.mark.parametrize("at_once, proposals", [(40, 0), (3, 1), (10_000, 2)])
def test_choice_in_stretches(spark, at_once, proposals):
    """All templates name the same classes, in one order, and some others."""
    rnd = random.Random(at_once)
    names = [f"C{i}" for i in range(9)]
    refs = {f"t{i:02}": names[:] if i % 3 else rnd.sample(names, rnd.randrange(len(names))) for i in range(12)}
    taken = {}
    for t in sorted(refs):
        if c := next((c for c in refs[t] if c not in taken), None):
            taken[c] = t
    offers = spark.createDataFrame([(t, i, c) for t, cs in refs.items() for i, c in enumerate(cs)], "template string, pos int, name string")
    got = training.serial_choice(offers, at_once, proposals)
    assert {tuple(r) for r in got.select("name", "keeper").collect()} == set(taken.items())
