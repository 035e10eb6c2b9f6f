"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        twin = duck.sql(catalog.ORACLES[name])
        assert got == rows(twin.columns, twin.fetchall())
    else:
        assert got[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Top-k without a sort of everything, pushed filters, pruned columns."""
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["vector_topk"](spark, SF))
    p = plan(catalog.QUERIES["prefix_filter"](spark, SF))
    assert "StringStartsWith(source,src1)" in p and "text" not in p.split("ReadSchema")[1]
    assert "ReadSchema: struct<source:string>" in plan(catalog.QUERIES["stats_source"](spark, SF))
    assert "CartesianProduct" not in plan(catalog.QUERIES["dependency_expand"](spark, SF))
