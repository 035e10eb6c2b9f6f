"""Source trees as a data source: ``spark.read.format("source_tree").load(folder)`` gives path, suffix, bytes, text.

    register(spark)
    spark.read.format("source_tree").option("suffixes", ".java,.py").load("/src").filter("bytes < 1000000")

The folder is listed once when the scan is planned; files are dealt into partitions by size. Suffixes, parts of paths and bounds
of size reach the listing, so files that do not match are never opened, and with only paths and sizes asked for none is. A
file that is no UTF-8 gives no row; an empty one gives an empty text."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of text in one Arrow batch, about.
BATCH_BYTES = 8_000_000


def suffix_of(path: str) -> str:
    """In lower case, with its dot; empty if the name has none."""
    return posixpath.splitext(posixpath.basename(path))[1].lower()


_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Files(InputPartition):
    """Paths and sizes that one task reads."""

    paths: list
    sizes: list


class SourceTree(DataSource):
    """Options: path (of any file system that pyarrow knows), suffixes (comma-separated; all by default), recursive (true),
    partitionBytes (32 MB: files of about so many bytes are one partition), text (true; false leaves texts out, so that no file
    is opened and one that is no UTF-8 has a row, too)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, suffix string, bytes long" + (", text string" if self._text() else "")

    def _text(self) -> bool:
        return self.options.get("text", "true").lower() != "false"

    def reader(self, schema) -> TreeReader:
        if "path" not in self.options:
            raise ValueError("source_tree needs a folder: load(folder)")
        suffixes = [s.strip().lower() for s in self.options.get("suffixes", "").split(",") if s.strip()]
        return TreeReader(self.options["path"], suffixes, self.options.get("recursive", "true").lower() != "false", int(self.options.get("partitionBytes", 32_000_000)), self._text())


class TreeReader(DataSourceReader):
    def __init__(self, folder: str, suffixes: list[str], recursive: bool, partition_bytes: int, text: bool):
        self.folder, self.suffixes, self.recursive, self.partition_bytes, self.text = folder, suffixes, recursive, max(partition_bytes, 1), text
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what can be told from a path and a size; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in ("path", "suffix", "bytes") and f.value is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, path: str, size: int) -> bool:
        known = {"path": path, "suffix": suffix_of(path), "bytes": size}
        return (not self.suffixes or known["suffix"] in self.suffixes) and all(_TESTS[kind](known[column], value) for column, kind, value in self.tests)

    def _system(self):
        from pyarrow import fs

        system, folder = (fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder))
        return system, folder.rstrip("/") or "/"

    def partitions(self) -> list[Files]:
        """Files by path, dealt in order: a partition ends when it has ``partitionBytes``."""
        from pyarrow import fs

        system, folder = self._system()
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(folder, recursive=self.recursive)) if i.type == fs.FileType.File and self._wanted(i.path, i.size))
        parts: list[Files] = []
        room = 0
        for path, size in found:
            if room <= 0:
                parts.append(Files([], []))
                room = self.partition_bytes
            parts[-1].paths.append(path)
            parts[-1].sizes.append(size)
            room -= max(size, 1)
        return parts or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        rows, held = [], 0
        for path, size in zip(partition.paths, partition.sizes, strict=True):
            row = (path, suffix_of(path), size)
            if self.text:
                with system.open_input_stream(path) as stream:
                    raw = stream.read()
                try:
                    row += (raw.decode("utf-8"),)
                except UnicodeDecodeError:
                    continue
                held += len(raw)
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "suffix": pa.string(), "bytes": pa.int64()} | ({"text": pa.string()} if self.text else {})
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.dataSource.register(SourceTree)
    spark.conf.set(PUSHDOWN, "true")
