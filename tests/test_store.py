"""Layers: what a change costs, two writers, resets, folding, removal, lookups."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import layers
from tessera.operators.store import CHUNK_SCHEMA, ChunkStore

TYPES = dict(x.split(" ") for x in CHUNK_SCHEMA.split(", "))


def chunks(spark, ids, content="x" * 200, path="a"):
    """Rows of the schema; the seq is the number of the row."""
    rows = [(str(i), f"{content}{i}", f"{path}{i % 7}/f", f"C{i}", n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id string, content string, file_path string, class_name string, seq int")
    df = df.withColumns({"language": F.lit("java"), "chunk_type": F.lit("class"), "embedding": F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")})
    return df.withColumns({c: F.lit(None).cast(t) for c, t in TYPES.items() if c not in df.columns})


@pytest.fixture
def store(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), dims=2, buckets=4)
    s.create()
    return s


def contents(s, version=None):
    return {r.id: r.content for r in s.read(version).select("id", "content").collect()}


def bytes_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_a_change_costs_its_own_rows(spark, store):
    import hashlib

    wide = chunks(spark, range(8_000)).withColumn("content", F.concat(F.sha2("content", 512), F.sha2("id", 512), F.sha2("file_path", 512)))
    assert store.upsert(wide) == 8_000
    before = bytes_of(store.path)
    assert store.upsert(wide.filter("cast(id AS int) % 100 = 7").withColumn("content", F.upper("content"))) == 80
    assert bytes_of(store.path) - before < 0.05 * before
    now = contents(store)
    assert len(now) == 8_000 and sum(c.isupper() for c in now.values()) == 80
    assert now["8"].startswith(hashlib.sha512(("x" * 200 + "8").encode()).hexdigest())


def test_last_row_and_creation_time(spark, store):
    store.upsert(chunks(spark, [1, 2, 2, 3]).withColumn("content", F.concat("content", F.lit(" "), "seq")))
    first = {r.id: r.created_at for r in store.read().collect()}
    assert contents(store)["2"].endswith(" 2")
    assert store.upsert(chunks(spark, [2, 4], content="new")) == 2
    again = {r.id: r.created_at for r in store.read().collect()}
    assert {k: again[k] for k in first} == first and again["4"] > first["1"]
    assert contents(store)["2"] == "new2" and contents(store, 1)["2"].startswith("xx")
    with pytest.raises(Exception, match="without an id"):
        store.upsert(chunks(spark, [9]).withColumn("id", F.lit(None).cast("string")))


def test_two_writers(spark, store):
    store.upsert(chunks(spark, range(10)))
    seen = store.version()
    other = ChunkStore(spark, store.path, dims=2, buckets=4)
    other.upsert(chunks(spark, [3], content="theirs"))
    with pytest.raises(layers.Conflict):
        store.upsert(chunks(spark, [3, 4], content="mine"), since=seen)
    assert contents(store)["3"] == "theirs3" and not contents(store)["4"].startswith("mine")
    assert len(list(Path(store.path).glob("layer-*"))) == len(store.version().layers)
    store.upsert(chunks(spark, [4], content="mine"))
    assert contents(store)["4"] == "mine4"


def test_unfinished_version_is_not_there(spark, store):
    store.upsert(chunks(spark, [1]))
    n = store.version().n
    (Path(store.path) / "log" / f"{n + 1:012d}.json").write_text("")
    assert store.version().n == n and set(contents(store)) == {"1"}


def test_resets(spark, store):
    store.upsert(chunks(spark, [1, 2]))
    for _ in range(2):
        store.create()
        assert store.is_empty()
    store.upsert(chunks(spark, [3]))
    assert set(contents(store)) == {"3"}
    assert len(store.vacuum()) == 1 and set(contents(store)) == {"3"}


@pytest.mark.parametrize("few", [1_000_000, 12, 1])
def test_many_changes(spark, store, monkeypatch, few):
    """All ways to join the keys that are gone: broadcast, by bucket, shuffled; with folds on the way."""
    monkeypatch.setattr(layers, "BROADCAST_KEYS", few)
    monkeypatch.setattr(layers, "MOST_LAYERS", 3)
    expected = {}
    for step, ids in enumerate([range(40), range(5, 12), range(30, 42), [7, 7, 41]]):
        store.upsert(chunks(spark, ids, content=f"s{step} "))
        expected |= {str(i): f"s{step} {i}" for i in ids}
        if step == 2:
            assert store.delete_by_prefix("a3/") == sum(int(i) % 7 == 3 for i in expected) and store.delete_by_prefix("a3/") == 0
            assert store.delete_by_file("a4/f") == sum(int(i) % 7 == 4 for i in expected)
            expected = {i: c for i, c in expected.items() if int(i) % 7 not in (3, 4)}
        assert contents(store) == expected
    assert len(store.version().layers) <= 5
    assert {r.id: r.content for r in store.lookup(["7", "3", "41", "nobody"]).collect()} == {i: expected[i] for i in ("7", "41")}
    store.compact()
    assert contents(store) == expected and len(store.version().layers) == 1
    removed = store.vacuum(keep=2)
    assert removed and contents(store) == expected
    store.vacuum()
    assert contents(store) == expected and len(list(Path(store.path).glob("layer-*"))) == 1 == len(store.table.versions())


def test_lookup_reads_its_buckets(spark, store):
    store.upsert(chunks(spark, range(4000)))
    plan = store.lookup(["17"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters: [In(id" in plan or "EqualTo(id" in plan
    files = store.lookup(["17"]).select(F.input_file_name()).distinct().count()
    assert files == 1 and store.read().select(F.input_file_name()).distinct().count() >= 4


def test_sketches(spark, store):
    assert store.distinct().collect()[0].file_path in (0, None)
    store.upsert(chunks(spark, range(500)))
    store.upsert(chunks(spark, range(250, 900), path="b").withColumn("class_name", F.concat(F.lit("C"), "seq")))
    (r,) = store.distinct("language").collect()
    assert r.language == "java" and r.file_path == 14 and abs(r.class_name - 650) <= 13
    plan = store.distinct("language")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "/rows" not in plan
