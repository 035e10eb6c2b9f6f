"""The data source of source trees against the scan of binary files, and what its filters keep from being opened."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThan, StringEndsWith

from tessera.sources import files, tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(30):
        at = root / ("a" if i % 2 else "b/c") / f"f{i}{('.py', '.JAVA', '.md')[i % 3]}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text {i} é\r\n" * i, encoding="utf-8")
    (root / "bad.py").write_bytes(b"x = '\xff\xfe'")
    (root / "plain").write_text("no suffix")
    return str(root)


def loaded(spark, folder, **options):
    tree.register(spark)
    return spark.read.format("source_tree").options(**options).load(folder)


def test_rows_equal_the_binary_scan(spark, folder):
    got = loaded(spark, folder, suffixes=".py,.md").select(F.concat(F.lit("file:"), "path").alias("path"), "text")
    assert got.count() == 20  # Spark's scan of binary files leaves out the empty one
    assert sorted(got.filter("text <> ''").collect()) == sorted(files.files(spark, folder, [".py", ".md"]).collect())
    assert loaded(spark, f"file://{folder}").count() == 31 == loaded(spark, folder).count()
    assert {r.suffix for r in loaded(spark, folder).collect()} == {".py", ".java", ".md", ""}
    assert [r.text for r in loaded(spark, folder, recursive="false").collect()] == ["no suffix"]


def test_partitions_by_size(spark, folder):
    small = loaded(spark, folder, partitionBytes="500")
    assert small.rdd.getNumPartitions() > 3 > loaded(spark, folder).rdd.getNumPartitions() and sorted(small.collect()) == sorted(loaded(spark, folder).collect())


def test_filters_reach_the_listing(folder):
    reader = tree.SourceTree({"path": folder}).reader(None)
    kept = list(reader.pushFilters([EqualTo(("suffix",), ".py"), LessThan(("bytes",), 200), StringEndsWith(("text",), "x"), EqualTo(("path", "x"), "y")]))
    assert [f.attribute for f in kept] == [("text",), ("path", "x")]
    (part,) = reader.partitions()
    assert part.paths and all(p.endswith(".py") and s < 200 for p, s in zip(part.paths, part.sizes))


def test_files_over_the_limit_are_never_opened(spark, folder, tmp_path):
    (tmp_path / "small.py").write_text("x = 1\n")
    (tmp_path / "gone.py").write_text("y = 2\n" * 100)
    reader = tree.SourceTree({"path": str(tmp_path)}).reader(None)
    list(reader.pushFilters([LessThan(("bytes",), 100)]))
    planned = reader.partitions()
    (tmp_path / "gone.py").unlink()  # reading it would fail now
    assert [b.column("path").to_pylist() for p in planned for b in reader.read(p)] == [[str(tmp_path / "small.py")]]
    assert loaded(spark, folder).filter("bytes < 60 AND suffix = '.py'").count() == sum(os.path.getsize(os.path.join(d, f)) < 60 and f.endswith(".py") and f != "bad.py" for d, _, n in os.walk(folder) for f in n)


def test_sizes_without_texts(spark, folder):
    got = loaded(spark, folder, text="false")
    assert got.columns == ["path", "suffix", "bytes"] and got.count() == 32
    assert {r.path: r.bytes for r in got.collect()} == {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, n in os.walk(folder) for f in n}


def test_empty_and_missing(spark, folder, tmp_path):
    assert loaded(spark, str(tmp_path)).count() == 0 and loaded(spark, folder, suffixes=".none").count() == 0
    with pytest.raises(Exception, match="does not exist|No such|not found|annot"):
        loaded(spark, str(tmp_path / "none")).count()
