"""Queries that read source files of any length, on a table with longer ones than the operators' bounds."""

import duckdb
import pytest

from tessera.plans import catalog
from test_queries import rows


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Twenty short documents, and two of 600 and 2,500 lines."""
    folder = tmp_path_factory.mktemp("long")
    text = lambda n: "\n".join(f"Line Nr{i} of it" for i in range(n))
    docs = [(i, text(n), "en", "src1", len(text(n))) for i, n in enumerate([3] * 20 + [600, 2500])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def whole(spark, folder, name):
    """Rows of a query, which are those of its SQL."""
    df = catalog.QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    twin = duck.sql(catalog.ORACLES[name])
    assert rows(df.columns, got) == rows(twin.columns, twin.fetchall())
    return df.columns, got


def test_blocks_of_long_files(spark, long_texts):
    names, got = whole(spark, long_texts, "block_chunks")
    assert len(got) == 22 * 3
    last = [r for r in got if r[names.index("file_path")] == "tools/doc21.py"]
    assert {r[names.index("chunk_type")] for r in last} == {"module", "class", "function"} and all("Nr2499" in r[names.index("references")] for r in last if r[names.index("chunk_type")] != "class")


def test_references_of_long_files(spark, long_texts):
    names, got = whole(spark, long_texts, "java_references")
    found = {r[names.index("path")]: r[names.index("references")] for r in got}
    assert len(found) == 21 and found["java/Doc21.java"] == "Doc10,Doc4,Doc7"


def test_tiers_of_long_files(spark, long_texts):
    """The class of the longest file is the one that template Doc21 is named like."""
    names, got = whole(spark, long_texts, "tier_counts")
    assert dict(zip(*([r[names.index(c)] for r in got] for c in ("tier", "n")), strict=True)) == {"manual": 1, "exact": 4, "reference": 12}
