"""SimHash near duplicates against brute force."""

import random

import numpy as np
import xxhash

from tessera.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows (doc_id, fingerprint) -> component ids by the smallest reachable id."""
    comp = {}
    for i in range(len(rows)):
        if i in comp:
            continue
        stack, seen = [i], {i}
        while stack:
            x = stack.pop()
            for y in range(len(rows)):
                if y not in seen and (rows[x][1] ^ rows[y][1]).bit_count() <= 2:
                    seen.add(y)
                    stack.append(y)
        low = min(rows[x][0] for x in seen)
        comp |= dict.fromkeys(seen, low)
    return [comp[i] for i in range(len(rows))]


def code_words():
    """All words of the code, from its generator."""
    words = {0}
    for i in range(12):
        words |= {w ^ simhash.GOLAY << i for w in words}
    return np.array(sorted(words))


def test_code_covers_with_radius_three():
    rng = np.random.default_rng(0)
    for v in rng.integers(0, 1 << 23, 300):
        assert (np.bitwise_count(code_words() ^ v) <= simhash.RADIUS).sum() == 1


def test_anchors_are_all_within_radius_plus_threshold():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    keys, filled = simhash.anchors(fps, 2)
    words = code_words()
    for f, key, ok in zip(fps, keys, filled, strict=True):
        beyond = [np.maximum(0, np.bitwise_count(words ^ (int(f) >> first & ((1 << width) - 1))).astype(int) - 3) for first, width in simhash.BLOCKS]
        near = [[(int(w) >> 11, int(e)) for w, e in zip(words, x, strict=True) if e <= 2] for x in beyond]
        expected = {a << 24 | b << 12 | c for a, i in near[0] for b, j in near[1] for c, k in near[2] if i + j + k <= 2}
        assert sorted(key[ok].tolist()) == sorted(expected)
        assert ok[0] and all(min(x[words >> 11 == key[0] >> n & 4095]) == 0 for x, n in zip(beyond, (24, 12, 0), strict=True))


def test_pairs_within_two_bits_meet_at_both_homes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for _ in range(3):
        y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
        (kx, _), (ky, filled) = simhash.anchors(x, 2), simhash.anchors(y, 2)
        assert ((kx[:, :1] == ky) & filled).any(axis=1).all()


def brute_classes(fps):
    """A class label for each fingerprint, by a union over neighbours within two bits."""
    known, label = set(fps), {}
    masks = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    for f in fps:
        if f not in label:
            label[f], stack = f, [f]
            while stack:
                x = stack.pop()
                for m in masks:
                    if (y := x ^ m) in known and y not in label:
                        label[y] = f
                        stack.append(y)
    return [label[f] for f in fps]


def components(spark, fps):
    docs = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    links = simhash.links(docs.select("fp").distinct(), 2)
    roots = {r.node: r.root for r in simhash.connected_components(links, "a", "b").collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    low = {}
    for i, f in enumerate(signed):
        low.setdefault(roots.get(f, f), i)
    return [low[roots.get(f, f)] for f in signed]


def test_components_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        f = rnd.choice(fps)
        for _ in range(rnd.choice([0, 1, 2, 3])):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    expected = brute_components(list(enumerate(fps)))
    assert components(spark, fps) == expected


def test_crowded_anchors_are_refined(spark):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(13), rnd.randrange(13))) for _ in range(6000)})
    assert len(fps) > 2 * simhash.ANCHOR_ROWS
    # any two values are linked by steps of one bit, up to those that were not drawn
    assert len(set(components(spark, fps))) == len(set(brute_classes(fps)))


def test_rows_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d", "x"), (2, None, "x"), (3, "", None), (4, " \t\n", "x"), (4, " \t\n", "x"), (5, long, "x"), (6, long + " tail", "x"), (7, "Only two", "x"), (8, "only TWO", "x"), (None, "é à", "x"), (9, "É à", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = {(r.doc_id, r.fp): r["first"].doc_id for r in simhash.near_duplicates(docs).collect()}
    by_id = {k[0]: int(np.int64(k[1]).view(np.uint64)) for k in out}
    assert by_id == {r[0]: brute_fingerprint(r[1]) for r in rows}
    no_id = len(rows)  # a null id is larger than any other
    low = brute_components([(no_id if r[0] is None else r[0], brute_fingerprint(r[1])) for r in rows])
    assert {k[0]: v for k, v in out.items()} == {r[0]: None if c == no_id else c for r, c in zip(rows, low, strict=True)}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(set(out.values()), key=str)
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
