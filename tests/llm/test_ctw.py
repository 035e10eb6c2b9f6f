"""Context-tree weighting against a sequential coder, and scores against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ctw


def test_log_gamma():
    x = np.r_[0.5:20:0.5, 100.5, 1e6 + 0.5]
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)



class Sequential:
    """Textbook weighting: probabilities of blocks by recursion; a prediction is a ratio of two block probabilities."""

    def __init__(self, pairs, depth):
        self.depth = depth
        self.kids = defaultdict(set)
        self.count = defaultdict(lambda: [0, 0])  # (context, bit node) -> zeros, ones
        for context, byte in pairs:
            self.add(context, byte)

    def bits(self, byte):
        m = 1
        for k in range(7, -1, -1):
            yield m, byte >> k & 1
            m = 2 * m + (byte >> k & 1)

    def add(self, context, byte, n=1):
        for d in range(self.depth + 1):
            if d < self.depth:
                self.kids[context[:d]].add(context[: d + 1])
            for m, bit in self.bits(byte):
                self.count[context[:d], m][bit] += n

    def weighted(self, node, m):
        z, o = self.count[node, m]
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        if len(node) == self.depth:
            return own
        return np.logaddexp(own, sum(self.weighted(k, m) for k in list(self.kids[node]))) - math.log(2)

    def log10(self, context, byte):
        total = -sum(self.weighted(b"", m) for m, _ in self.bits(byte))
        self.add(context, byte)
        total += sum(self.weighted(b"", m) for m, _ in self.bits(byte))
        self.add(context, byte, -1)
        return total / math.log(10)


def grams_of(texts, depth):
    """(context, nearest byte first; byte) of each coded byte."""
    for t in texts:
        s = b"\xff" * depth + b" ".join(t.lower().split()) + b"\xff"
        for i in range(depth, len(s)):
            yield s[i - depth : i][::-1], s[i]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_costs_equal_ratios_of_block_probabilities(spark, depth):
    rnd = random.Random(depth)
    train = ["".join(rnd.choice("abcab ") for _ in range(60)).encode() for _ in range(4)]
    other = ["".join(rnd.choice("abc xy") for _ in range(30)).encode(), b"", "été".encode()]
    seen, asked = Counter(grams_of(train, depth)), Counter(grams_of(train + other, depth))
    number = lambda c, b: int.from_bytes(c + bytes([b]), "big")
    table = spark.createDataFrame([(number(*g), n, seen[g]) for g, n in asked.items()], "gram long, n long, train long").repartition(3)
    got = {r.gram: (r.n, r.cost) for r in ctw.gram_costs(table, depth).collect()}
    slow = Sequential(list(seen.elements()), depth)
    assert set(got) == {number(*g) for g in asked}
    for g, n in asked.items():
        assert got[number(*g)][0] == n and abs(got[number(*g)][1] - slow.log10(*g)) < 1e-6


def test_probabilities_of_all_bytes_add_up_to_one(spark):
    seen = Counter(grams_of([b"some text that is read", b"and some more of it"], 6))
    context = b"emos \xff"
    rows = {int.from_bytes(c + bytes([b]), "big"): n for (c, b), n in seen.items()}
    rows |= {k: rows.get(k, 0) for k in (int.from_bytes(context + bytes([b]), "big") for b in range(256))}
    table = spark.createDataFrame([(k, 1, n) for k, n in rows.items()], "gram long, n long, train long")
    costs = {r.gram: r.cost for r in ctw.gram_costs(table, 6).collect()}
    assert abs(sum(10 ** costs[int.from_bytes(context + bytes([b]), "big")] for b in range(256)) - 1) < 1e-9


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5000))
    values = rng.random(len(keys))
    got, absent = ctw.Lookup(keys, values).get(np.r_[keys, keys + 1])
    assert np.array_equal(got[: len(keys)], values) and set(range(len(keys), 2 * len(keys))) >= set(absent.tolist())
    assert ctw.Lookup(keys[:0], values[:0]).get(keys)[1].tolist() == list(range(len(keys)))


def test_blocks_hold_whole_slices():
    x = np.repeat(np.arange(50), np.arange(50))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 7])], names=["x"]) for i in range(0, len(x), 7)]
    blocks = [b[0] for b in ctw._blocks(iter(batches), 20)]
    assert np.array_equal(np.concatenate(blocks), x) and len(blocks) > 5
    assert all(a[-1] != b[0] for a, b in zip(blocks, blocks[1:], strict=False))


def plain_scores(rows, depth):
    """Log10 probability of each text by one tree in memory: dictionaries over all contexts."""
    coded = [list(grams_of([(t or "").encode()], depth)) for _, t in rows]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    seen = Counter(g for gs, o in zip(coded, out, strict=True) if not o for g in gs)
    count = defaultdict(lambda: [0, 0])
    for (c, b), n in seen.items():
        for d in range(depth + 1):
            for j in range(8):
                count[c[:d], (256 | b) >> (8 - j)][b >> (7 - j) & 1] += n
    estimate, weight, split = {}, {}, defaultdict(float)
    for (c, m), (z, o) in sorted(count.items(), key=lambda x: -len(x[0][0])):
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        both = own if len(c) == depth else float(np.logaddexp(own, split[c, m])) - math.log(2)
        estimate[c, m], weight[c, m] = (o + 0.5) / (z + o + 1), 1.0 if len(c) == depth else math.exp(own - math.log(2) - both)
        if c:
            split[c[:-1], m] += both
    cost = {}
    for c, b in {g for gs in coded for g in gs}:
        total = 0.0
        for j in range(8):
            m, p = (256 | b) >> (8 - j), 0.5
            for d in range(depth, -1, -1):
                if (c[:d], m) in weight:
                    w = weight[c[:d], m]
                    p = w * estimate[c[:d], m] + (1 - w) * p
            total += math.log10(p if b >> (7 - j) & 1 else 1 - p)
        cost[c, b] = total
    return [sum(cost[g] for g in gs) for gs in coded]


def test_whole_table_against_one_tree(spark):
    """All documents of the smallest table; where grams and words are looked up makes no difference."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = sorted((d, round(s, 5)) for (d, _), s in zip(rows, plain_scores(rows, 6), strict=True))
    first = {r.doc_id: r for r in ctw.score(docs, depth=6).collect()}
    assert sorted((r.doc_id, round(r.score, 5)) for r in first.values()) == wanted
    held = [r for r in first.values() if r.held_out]
    assert sum(r.score for r in held) > -87_100
    for r in ctw.score(docs.repartition(7), depth=6, head_bits=9, word_bits=6).collect():
        assert abs(r.score - first[r.doc_id].score) < 1e-6 and abs(r.base_score - first[r.doc_id].base_score) < 1e-6 and r.n_known == first[r.doc_id].n_known


def brute_base(rows):
    words = lambda t: (t or "").encode().lower().split()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter()
    for d, t in rows:
        if not out(d):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    return [(d, out(d), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for d, t in rows]


def test_scores(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the", "The", "a\tb", "été", "x" * rnd.randrange(1, 9)]) for _ in range(rnd.randrange(40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "no id"), (1, rows[1][1]), (1, rows[1][1]), (62, "the été " * 40_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    for head_bits, word_bits in ((21, 18), (4, 3)):
        got = ctw.score(docs, head_bits=head_bits, word_bits=word_bits).collect()
        key = lambda r: (str(r[0]), *r[1:5], round(r[5], 3))
        assert sorted(key(tuple(r[1:7])) for r in got) == sorted(key(r) for r in brute_base(rows))
        assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    nothing = ctw.score(docs.filter("doc_id = -1"))
    assert nothing.count() == 0


def test_model_beats_uniform_and_learns(spark):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["spark", "plans", "join", "tables"]) for _ in range(200))) for i in range(100)], "doc_id long, text string")
    rows = [r for r in ctw.score(docs).collect() if r.held_out]
    assert rows and all(r.bits_per_byte < 1.0 for r in rows)


def test_grams_leave_a_task_about_once(spark, monkeypatch):
    """Counts are exact, also beyond what a packed count holds and when a task has to send on early; each task sends a gram once
    where its codes fit, and nothing is aggregated before the shuffle."""
    rnd = random.Random(3)
    texts = ["ab " * 400, None, "", "a"] + [" ".join(rnd.choice(["alpha", "beta", "gamma", "d"]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    rows = [(t, bool(i % 3)) for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "text string, learn boolean").coalesce(1)
    expected = {}
    for t, learn in rows:
        raw = bytes([255]) * 4 + b" ".join(ctw.words_of((t or "").encode())) + bytes([255])
        for i in range(4, len(raw)):
            gram = int.from_bytes(raw[i - 4 : i][::-1] + raw[i : i + 1], "big")
            n, train = expected.get(gram, (0, 0))
            expected[gram] = (n + 1, train + learn)
    assert max(n for n, _ in expected.values()) > 3 * 127
    for most in (4_000_000, 20):
        monkeypatch.setattr(ctw, "AT_ONCE", 250_000 if most > 20 else 64)
        counts = ctw.gram_counts(plain, 4, most)
        assert {r.gram: (r.n, r.train) for r in counts.collect()} == expected
    plan = ctw.gram_counts(plain, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("MapInArrow")
