"""Quality classifier: held-out accuracy on the tables, features against a plain version, odd rows."""

import zlib

import numpy as np
import pytest

from tessera.llm import quality as q
from tessera.llm import tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return q.fit(*tables)


def test_held_out_labels(tables, model):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score >= q.THRESHOLD, truth[r.doc_id]) for r in q.score(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([p == bool(y) for p, y in held]) > 0.97


def test_fit_is_bounded_and_repeatable(tables, model):
    again = q.fit(*tables)
    assert np.array_equal(again.weight, model.weight) and (again.slope, again.shift) == (model.slope, model.shift)
    few = q.fit(*tables, max_labelled=40)
    assert few.weight.any() and not np.array_equal(few.weight, model.weight)


def test_batches_do_not_change_scores(model):
    texts = [b"The cat sat.", b"", b"WORD!! WORD!! WORD!!", "é ü | ñ | ß |".encode(), b"a a a a a a", b" \n "]
    at = np.cumsum([0, *map(len, texts)])
    every = model.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    one = [model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(every, one, atol=1e-12)


def test_dual_descent_satisfies_optimality():
    """Each row is outside the margin with no weight, on it, or inside with the largest weight."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    scale, cost = rng.uniform(0.5, 2, 30), np.full(60, 1.0)
    w = q.dual_coordinate_descent(rows, y, scale, cost, epochs=400)
    primal = 0.5 * w @ w + sum(c * max(0, 1 - (1 if t else -1) * (w[r] @ (scale[r] / np.linalg.norm(scale[r])))) for r, t, c in zip(rows, y, cost, strict=True))
    worse = min(0.5 * v @ v + sum(max(0, 1 - (1 if t else -1) * (v[r] @ (scale[r] / np.linalg.norm(scale[r])))) for r, t in zip(rows, y, strict=True)) for v in (w + 0.05 * rng.normal(size=30) for _ in range(300)))
    assert primal <= worse


def test_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "The quick text.", "x"), (3, "word " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.score) for r in q.score(docs, model).collect()]
    assert sorted(str(d) for d, _ in got) == sorted(str(r[0]) for r in rows) and all(0 <= s <= 1 for _, s in got)
    kept = q.drop_low_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= q.THRESHOLD for _, s in got)
    assert q.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    one_class = q.fit(docs, labels)
    assert all(0 < r.score < 1 for r in q.score(docs, one_class).collect())
    nothing = q.fit(docs.limit(0), labels.limit(0))
    assert q.score(docs, nothing).count() == len(rows)


def plain_hash(word: bytes) -> int:
    """The hash of a word, byte by byte."""
    total = sum(int(tokens._BYTE[c]) * int(tokens._PLACE[i & 63]) for i, c in enumerate(word)) + len(word)
    return plain_mix(total % 2**64)


def plain_mix(h: int) -> int:
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
    return (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64


def plain_features(text: bytes) -> list[int]:
    """Words, pairs of words, and shapes of one to three words, one at a time."""
    words = text.split()
    is_word = lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127
    keys, shapes, hashes, prime = [], [], [plain_hash(w) for w in words], 0x9E3779B97F4A7C15
    for i, w in enumerate(words):
        upper, lower, high = sum(65 <= c <= 90 for c in w), sum(97 <= c <= 122 for c in w), sum(c > 127 for c in w)
        case = 0 if not upper + lower + high else 1 if not upper else 3 if not lower and upper > 1 else 2 if upper == 1 else 4
        begin, tail = (0 if is_word(c) else c for c in (w[0], w[-1]))
        tail2 = 0 if len(w) < 2 or is_word(w[-2]) else w[-2]
        repeat = i > 0 and hashes[i] == hashes[i - 1]
        shapes.append(plain_mix((((((case * 256 + begin) * 256 + tail) * 256 + tail2) * 2 + any(48 <= c <= 57 for c in w)) * 2 + repeat) + 1))
        keys += [hashes[i], shapes[i]]
        if i > 0:
            keys += [plain_mix((shapes[i - 1] * prime + shapes[i]) % 2**64), plain_mix((hashes[i - 1] * prime + hashes[i] + 7) % 2**64)]
        if i > 1:
            keys.append(plain_mix(((shapes[i - 2] * prime + shapes[i - 1]) * prime + shapes[i]) % 2**64))
    return sorted({0} | {1 + k % ((1 << q.BITS) - 1) for k in keys})


def test_features_and_scores_equal_a_plain_version(tables, model):
    texts = [b"The cat sat.", b"", b"WORD!! WORD!! word!!", "é ü | ñ9 | ß |".encode(), b"a a a a", b" \n x", b"one", b"Ab1; -- (c)"] + [(r.text or "").encode()[:3000] for r in tables[0].limit(40).collect()]
    at = np.cumsum([0, *map(len, texts)])
    feature, first = q.features(np.frombuffer(b"".join(texts), np.uint8), at)
    scores = model.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    for i, t in enumerate(texts):
        plain = plain_features(t)
        assert feature[first[i] : first[i + 1]].tolist() == plain
        x = model.scale[plain]
        z = model.slope * float((x * model.weight[plain]).sum() / np.sqrt((x * x).sum())) + model.shift
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-9
