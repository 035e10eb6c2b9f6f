"""CRC algebra against zlib, draws against a plain version and the SQL twin."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, importance
from tessera.llm.common import utf8

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined(a, b):
    got = importance.joined(*(np.array([zlib.crc32(x)], np.uint32) for x in (a, b)), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


def test_many_bytes():
    for n in (0, 1, 2**20 + 3):
        got = importance.joined(np.array([zlib.crc32(b"abcd")], np.uint32), np.array([zlib.crc32(bytes(n))], np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(b"abcd" + bytes(n))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, most, buckets, least, share, seed="2024"):
    s, t = (Counter(zlib.crc32(g.encode()) % buckets for x in texts for g in grams(x, most)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = s.total(), t.total()

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))

    out = []
    for i, (d, text) in enumerate(docs):
        g = grams(text, most)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in g)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text)), i])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for place, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = place
    return sorted((str(r[0]), *map(str, r[1:5])) for r in out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abZ9 .-é漢\n", max_size=40), min_size=1, max_size=6))
def test_features(texts):
    import pyarrow as pa

    raw, at = utf8(pa.array(texts))
    for n, (crc, doc, count) in enumerate(importance.features(raw, at, 3), 1):
        expected = [(i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for w in [words(t)] for g in [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]]
        assert list(zip(doc.tolist(), crc.tolist(), strict=True)) == expected
        assert count.tolist() == [len(words(t)) for t in texts]


def odd_rows():
    long = " ".join(f"word{i % 700}" for i in range(40_000))
    base = [(1, "The cat, the cat. " * 8, 0), (2, None, 0), (3, "", 0), (3, "", 0), (None, "no id " * 15, 0), (4, long, 0), (5, "x" * 200_000, 0), (6, "É" * 60 + " é" * 30, 0), (6, "É" * 60 + " é" * 30, 0)]
    return base + [(100 + i, f"mat sat number{i} " * (i % 12), 0) for i in range(60)] + [(300 + i, "same text " * 20, 0) for i in range(40)]


def test_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([("a", "the cat sat on the mat"), ("b", None)], "item_id string, text string")
    for most in (1, 2, 3):
        got = importance.resample(docs, target, most_words=most, buckets=500, share_percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(tuple(map(str, r)) for r in got) == plain([r[:2] for r in rows], ["the cat sat on the mat"], most, 500, 20, 30)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(rows)


def test_query(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    twin = c.sql(catalog.ORACLES["op11_importance"])
    got = catalog.QUERIES["op11_importance"](spark, SF).select(*twin.columns)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(str, got.collect())) == sorted(f"Row({', '.join(f'{k}={v}' for k, v in zip(twin.columns, r, strict=True))})" for r in twin.fetchall())
    docs, target = (c.sql(f"SELECT {x} FROM {t}").fetchall() for x, t in (("doc_id, text", "documents"), ("text", "benchmark")))
    assert sorted(tuple(str(r[k]) for k in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == plain(docs, [t for (t,) in target], 1, 10_000, 20, 10)
