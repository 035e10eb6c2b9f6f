"""Kept indexes: cells against exact search, grams against the scan, and what they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, store
from tessera.operators.cell_index import CellIndex
from tessera.operators.gram_index import GramIndex, grams


def files_of(df):
    return df.select(F.input_file_name()).distinct().count()


def test_cells_are_kept(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 16))
    rows = [(i, [float(v) for v in centre[i % 60] + rng.normal(size=16) * 0.6]) for i in range(1500)] + [(9000, [0.0] * 16), (9001, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    index = CellIndex(spark, str(tmp_path / "cells"))
    assert not index.exists() and index.create(v.filter("vec_id % 4 <> 1"), lists=20) and index.exists()
    before = index.centres()
    index.add(v.filter("vec_id % 4 = 1"))
    assert not index.create(v) and index.centres() == before and index.read().count() == 1500
    asked = v.filter("vec_id % 50 = 0 AND vec_id < 1500")
    exact = search.vector_topk_many(v, asked, 10).select("qid", "id")
    assert index.search(asked, 10).join(exact, ["qid", "id"]).count() / 300 >= 0.9
    one = asked.filter("vec_id = 50")
    probed = index.probed(one, 3)
    assert probed.select("cell").distinct().count() == 3 and files_of(probed) < files_of(index.read()) / 5
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_recall_without_structure(spark, tmp_path):
    """Independent vectors in many cells: a quarter of the cells is too few, so their number is measured."""
    rng = np.random.default_rng(14)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(4000, 48)).tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = v.filter("vec_id % 50 = 0")
    exact = search.vector_topk_many(v, asked, 10).select("qid", "id")
    index = CellIndex(spark, str(tmp_path / "cells"))
    index.create(v.filter("vec_id % 10 <> 3"), lists=60)
    index.add(v.filter("vec_id % 10 = 3"))
    assert index.search(asked, 10).join(exact, ["qid", "id"]).count() / 800 >= 0.9
    celled, centres = store.build_cells(v, lists=60)
    assert store.search_cells(celled, centres, asked, 10).join(exact, ["qid", "id"]).count() / 800 >= 0.9
    assert store.probes_for(60) < index.probes() <= 60


def test_grams():
    assert len(grams("ab")) == 0 and len(grams("abcabc")) == 3 and len(grams("\U0010ffff" * 4)) == 1


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 107, 5))) for _ in range(400)]
    rows = [(f"d{i}", " ".join(rng.choice(words, 12)) + (" Needle-Straße İx" if i % 331 == 7 else ""), f"Class{i % 9}" if i % 2 else None, None if i % 3 else "getItem", "" if i % 5 else "Ünlü doc") for i in range(1500)]
    rows += [("empty", None, None, None, None), ("long", "spot " * 20_000 + "NEEDLE", "C", "m", None)]
    df = spark.createDataFrame(rows, "id string, content string, class_name string, method_name string, documentation string")
    index = GramIndex(spark, str(tmp_path_factory.mktemp("grams") / "g"), parts=4, blocks=24)
    index.add(df.filter("id <> 'long'"))
    index.add(df.filter("id = 'long'"))
    return df, index, words


@pytest.mark.parametrize("keywords", [["NEEDLE-str", "class3", "zzzz"], ["ünlü", "straße"], ["no such words"], ["getitem", "ne"], []])
def test_search_by_grams(indexed, keywords):
    df, index, _ = indexed
    assert index.keyword_search(keywords, 30, False).collect() == search.keyword_search(df, keywords, 30, False).collect()


def test_words_by_grams(indexed):
    df, index, words = indexed
    for w in words[:1]:
        assert index.keyword_search([w, w[1:4]], 2000).collect() == search.keyword_search(df, [w, w[1:4]], 2000).collect()
    assert index.read().count() == df.count()


def test_few_blocks_are_read(indexed):
    _, index, _ = indexed
    some = index.matching(["needle"])
    assert some.count() == 6 and files_of(some) <= 6 < files_of(index.read()) / 3
