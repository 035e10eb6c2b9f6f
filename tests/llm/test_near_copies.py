"""Near copies by shingle sets against brute force, alone and as a stage of the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import near_copies
from tessera.llm.components import connected_components


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows, similarity=0.8):
    """Smallest ids of the groups of rows (doc_id, text) that links join."""
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def made(n=60, seed=2):
    """Texts, copies with a few other words, and a line that many texts share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    line = " released under the terms of the license as it is stated in the file of that name"
    out = []
    for _ in range(n):
        words = [word() for _ in range(rnd.choice([1, 4, 5, 6, 20, 60, 200]))]
        out.append(" ".join(words) + (line if rnd.random() < 0.4 else ""))
        for _ in range(rnd.randrange(4)):
            copy = out[-1].split()
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy[rnd.randrange(3) :] or copy))
    return list(enumerate(out)) + [(1000, ""), (1001, " \n"), (1002, None), (1003, "One  two"), (1004, "one two")]


def test_pairs_equal_brute_force(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    kept = near_copies.drop_near_copies(spark.read.parquet(str(tmp_path / "docs")))
    expected = brute_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == expected and 20 < len(expected) < len(rows) - 20
    assert near_copies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_keys_in_parts(spark, monkeypatch):
    rows = made(seed=7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "HOT", 3)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == brute_kept(rows)


def test_neighbours_across_batches():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 12, 200))
    part, node, root = np.zeros(200, np.int64), np.arange(200), rng.integers(0, 3, 200)
    batch = lambda i, j: pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (key, part, node, root)], names=["key", "part", "node", "root"])
    expected = set()
    for k in range(12):
        own = np.flatnonzero(key == k)
        expected |= {(int(own[0]), int(x)) for x in own[1:] if root[x] != root[own[0]]} | {(int(x), int(y)) for x, y in zip(own, own[1:], strict=False) if root[x] != root[y]}
    for size in (1, 7, 200):
        got = [(a, b) for out in near_copies._neighbours(batch(i, i + size) for i in range(0, 200, size)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert set(got) == expected


def test_keys_meet_as_often_as_stated():
    """Of sets of similarity 0.8 nearly all share a key; of those of 0.3 few."""
    rng = np.random.default_rng(6)
    def shared(both, own):
        base = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
        return bool(set(near_copies.keys_of(base[: both + own]).tolist()) & set(near_copies.keys_of(np.r_[base[:both], base[both + own :]]).tolist()))
    assert sum(shared(80, 10) for _ in range(300)) >= 295 and sum(shared(60, 70) for _ in range(300)) < 40


def test_one_large_group_gives_few_pairs(spark):
    """Copies of one text that each lack some words: groups, not pairs, decide the work."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(300) for k in [i % 120]]
    assert [r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_groups_of_varied_changes(spark):
    """Copies of a few texts with up to four other words each: most pairs of a group are below the similarity, so a link has to be met."""
    rnd = random.Random(11)
    bases = [[f"b{b}w{i}" for i in range(120)] for b in range(6)]
    rows = []
    for i in range(900):
        words = list(bases[i % 6])
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_kept(rows)
    kept = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
    _, roots = near_copies.links(near_copies.with_row_id(docs), rounds=1)
    assert kept == expected and roots.count() > 0


def test_pipeline_stage_drops_near_copies_and_keeps_others(spark):
    """On the table: the stage of 2 fingerprint bits kept nearly all near copies and dropped pairs below 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = sorted(r.doc_id for r in stage(spark, docs, "/root/testdata/sf0.001").collect())
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_rounds_are_few_jobs(spark):
    """Rounds over few links are few jobs each: a driver keeps the traces of all of them."""
    sc = spark.sparkContext
    df = spark.createDataFrame(made(seed=9), "doc_id long, text string")
    sc.setJobGroup("near", "near copies")
    try:
        assert near_copies.drop_near_copies(df).count()
        jobs = len(sc.statusTracker().getJobIdsForGroup("near"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 160


def test_few_links_are_joined_as_many(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(900) * 7 - 2000, rnd.randrange(900) * 7 - 2000) for _ in range(700)] + [(i, i + 1) for i in range(10_000, 10_300)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    many, few = ({(r.node, r.root) for r in connected_components(df, "a", "b", at_once).collect()} for at_once in (0, 5000))
    assert few == many and (10_300, 10_000) in few
    assert {(r.node, r.root) for r in connected_components(df, "a", "b", 10).collect()} == many  # too many for one task
    assert connected_components(df.limit(0), "a", "b", 10).count() == 0


def test_shared_passage_gives_few_candidates(spark, monkeypatch):
    """A passage that many texts share puts them under the same keys; those that are not similar give later rounds nothing to join.
    Before, each round paired every member of such a key, 16 times."""
    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(100)]
    found = {}
    for n in (150, 300):
        rows = [(i, " ".join(passage + [f"o{rnd.randrange(10**6)}" for _ in range(30)])) for i in range(n)]
        base = [f"w{i}" for i in range(120)]
        for i in range(80):
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            rows.append((n + i, " ".join(words)))
        docs, rounds, real = spark.createDataFrame(rows, "doc_id long, text string"), [], type(spark.range(1)).join

        def join(self, other, on=None, how=None, rounds=rounds, real=real):
            if on == ["a", "b"] and how == "left_anti":
                rounds.append(self.count())
            return real(self, other, on, how)

        with monkeypatch.context() as m:
            m.setattr(type(docs), "join", join)
            kept = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
        assert kept == brute_kept(rows) and len(kept) < len(rows) and len(rounds) > 1
        found[n] = sum(rounds[1:])
    assert found[300] < 1000 and found[150] < 1000, found


def test_partners_are_all_that_may_be_similar():
    """All pairs of other roots that sizes and parities leave, where they are few; a bounded number of each member's where they are many."""
    rng = np.random.default_rng(13)
    node, root = rng.integers(-1 << 62, 1 << 62, 300), rng.integers(0, 200, 300)
    size = rng.integers(90, 140, 300)
    parity = np.zeros((300, 8), np.int64)
    parity[np.arange(300), rng.integers(0, 8, 300)] = rng.integers(0, 1 << 20, 300)
    expected = {}
    for i in range(300):
        for j in range(300):
            differ = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(parity[i], parity[j], strict=True))
            sizes = sorted((int(size[i]), int(size[j])))
            if root[i] != root[j] and sizes[0] >= 0.8 * sizes[1] and differ <= 0.2 / 1.8 * sum(sizes):
                expected.setdefault(int(node[i]), set()).add(int(node[j]))
    pairs = {(min(a, b), max(a, b)) for a, x in expected.items() for b in x}
    got = set(zip(*(x.tolist() for x in near_copies._partners(node, root, size, parity, 5, 0.8)), strict=True))
    assert got <= pairs and 16 * 300 < len(pairs) and len(got) <= 16 * 300
    for a, x in expected.items():
        met = {b for p in got if a in p for b in p} - {a}
        assert met <= x and len(met) >= min(16, len(x))
    other = set(zip(*(x.tolist() for x in near_copies._partners(node, root, size, parity, 6, 0.8)), strict=True))
    assert other != got
    few = slice(0, 16)
    own = set(node[few].tolist())
    assert set(zip(*(x.tolist() for x in near_copies._partners(node[few], root[few], size[few], parity[few], 5, 0.8)), strict=True)) == {p for p in pairs if set(p) <= own}


def test_all_partners_of_parts():
    """All pairs of other roots that sizes and parities leave, in one part and between two."""
    rng = np.random.default_rng(14)
    node, root, size = rng.permutation(400), rng.integers(0, 150, 400), rng.integers(90, 140, 400)
    parity = np.zeros((400, 8), np.int64)
    parity[np.arange(400), rng.integers(0, 8, 400)] = rng.integers(0, 1 << 30, 400)

    def plain(first, second):
        out = set()
        for i in first:
            for j in second:
                differ = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(parity[i], parity[j], strict=True))
                sizes = sorted((int(size[i]), int(size[j])))
                if root[i] != root[j] and sizes[0] >= 0.8 * sizes[1] and differ <= 0.2 / 1.8 * sum(sizes):
                    out.add((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return out

    for side in (np.zeros(400, np.int64), rng.integers(1, 3, 400)):
        got = [p for pairs in near_copies._all_partners(side, node, root, size, parity, 0.8) for p in zip(*(x.tolist() for x in pairs), strict=True)]
        expected = plain(np.flatnonzero(side != 2), np.flatnonzero(side != 1))
        assert len(got) == len(set(got)) and set(got) == expected and 400 < len(expected)


@pytest.mark.parametrize("hot", [1000, 70])
def test_links_that_no_round_draws(spark, monkeypatch, hot):
    """A key of 400 texts, nearly similar all of them, and three pairs that are: rounds draw some partners of each and find no
    link, or not all three."""
    rnd = random.Random(15)
    core = [f"c{i}" for i in range(262)]
    own = lambda n: [f"o{rnd.randrange(10**7)}" for _ in range(n)]
    texts = [core + own(37) for _ in range(394)]
    for _ in range(3):
        shared = own(20)
        texts += [core + shared + own(17) for _ in range(2)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_copies, "keys_of", lambda found: np.array([7], np.uint64))
    monkeypatch.setattr(near_copies, "HOT", hot)
    kept = sorted(r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == brute_kept(rows) and len(kept) == 397
