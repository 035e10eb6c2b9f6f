"""Exact duplicates against brute force; filters against plain counting."""

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 20), max_size=30), max_size=6), st.sampled_from([1, 4, 64]))
def test_slices_merge_without_loss(parts, number):
    scale, width = 1 << 27, (1 << ed.QUOTIENT_BITS) // number
    merged = {}
    for part in parts:
        if part:
            for i, raw in ed.CountingQuotientFilter.of(np.array(part, np.uint64) * np.uint64(scale)).slices(number):
                one = ed.CountingQuotientFilter.from_bytes(raw, i * width, width)
                merged[i] = one.merge(merged[i]) if i in merged else one
    found = {int(k) // scale: int(c) for f in merged.values() for k, c in zip(f.keys, f.counts, strict=True)}
    assert found == dict(Counter(x for p in parts for x in p))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=30), max_size=9))
def test_any_number_of_filters_merge(parts):
    whole = ed.merged(ed.CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts)
    found = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True)) if whole else {}
    assert found == dict(Counter(x for p in parts for x in p))


def test_row_ids_do_not_follow_the_cores(spark, tmp_path):
    from tessera.llm.common import SPLITS, with_row_id

    spark.range(100_000).selectExpr("id", "repeat(cast(id as string), 20) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = with_row_id(spark.read.parquet(str(tmp_path / "t")))
    assert int(spark.conf.get(SPLITS)) == spark.sparkContext.defaultParallelism
    before = rows.rdd.getNumPartitions()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() == before
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


ROWS = [(1, "A b", 0), (2, "a B", 0), (3, None, 0), (4, "", 0), (4, "", 0), (5, "É", 0), (6, "é", 0), (None, "a b", 0), (7, "x" * 300_000, 0), (8, "X" * 300_000, 0), (9, "one", 0), (None, "two", 0)]


def brute(rows):
    norm = lambda t: (t or "").encode().lower()
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append(d)
    return sorted((str(d), str(max((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for d, t, _ in rows)


def test_rows(spark):
    rows = ROWS + [(i, f"t{i % 7}", 0) for i in range(10, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    out = ed.exact_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute(rows)
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    kept = ed.drop_exact_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "rid"] and kept.count() == len({r.text_sha256 for r in out})
    assert ed.exact_duplicates(docs.limit(0)).count() == 0


def test_groups_compare_bytes(spark):
    """Texts that are taken for candidates by mistake are still told apart."""
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)] + [(9, "alone")], "doc_id long, text string")
    every = spark.createDataFrame([(ed.fingerprint(f"text {i}".encode()),) for i in range(3)] + [(ed.fingerprint(b"alone"),)], "fp long")
    groups = ed.verified_groups(docs, every, "text", "doc_id").collect()
    assert sorted((r["keep"].doc_id, r.group_size) for r in groups) == [(6, 3), (7, 3), (8, 3)]


def test_input_that_may_move_is_written_first(spark, tmp_path):
    """A sample or a shuffle may deliver other rows the next time; a scan with projections and filters does not."""
    from tessera.llm.common import settled

    spark.range(1000).selectExpr("id as doc_id", "cast(id % 300 as string) as text").write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t")).filter("doc_id > 5").withColumn("x", F.lit(1))
    assert settled(plain) is plain
    moved = plain.repartition(5).sample(0.9, seed=3).orderBy(F.rand())
    assert settled(moved) is not moved
    kept = ed.drop_exact_duplicates(moved)
    assert kept.count() == kept.select("text").distinct().count()


def test_groups_too_many_to_broadcast(spark, monkeypatch):
    """Large groups are broadcast, the others shuffled; the rows are the same."""
    docs = spark.createDataFrame([(i, f"t{min(i % 40, 9)}") for i in range(400)] + [(1000 + i, f"u{i // 2}") for i in range(60)], "doc_id long, text string")
    expected = sorted(map(tuple, ed.exact_duplicates(docs).drop("rid").collect()))
    monkeypatch.setattr(ed, "HOT_GROUP", 50)
    monkeypatch.setattr(ed, "small", lambda df: False)
    assert sorted(map(tuple, ed.exact_duplicates(docs).drop("rid").collect())) == expected
