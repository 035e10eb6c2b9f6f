"""A keyed table that changes without being rewritten: a stack of layers and a log of versions.

A change writes one layer: its new rows, and the keys that it takes away from the layers below (those of its new rows among
them). A reader joins rows with the highest layer that took their key away. A version is one small file of the log that
names its layers; it is made by creating a file that must not be there, so of two writers that start from one version the
second fails and its layer is removed. Files of older versions stay, for readers that are at work, until ``vacuum``.

At scale: a change costs its own rows. Rows are in buckets by the hash of their key. Keys taken away are broadcast up to
BROADCAST_KEYS, beyond that for one bucket at a time, so that the rows below never move; only past that they are shuffled.
Layers above the lowest one are folded into one when there are MOST_LAYERS, and the whole is folded when they are a good
part of it. Row groups carry ranges of the columns that rows are sorted by and Bloom filters of those that are looked up.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Keys up to which a table of them is broadcast.
BROADCAST_KEYS = 1_000_000
MOST_LAYERS = 12
#: Sketches of distinct values have 2 ** SKETCH_BITS buckets; the standard error is 1.04 over the root of that, 0.8 %.
SKETCH_BITS = 14
#: Rows of a bucket from which on its files have Bloom filters.
LOOKED_UP_ROWS = 10_000
#: Share of the lowest layer's rows from which on the layers above it are folded into it.
FOLD_SHARE = 0.25


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Layer:
    """A folder with ``rows`` and ``gone``: numbers of rows and of keys taken away from the layers below."""

    name: str
    rows: int
    gone: int


@dataclass(frozen=True)
class Version:
    n: int
    layers: tuple[Layer, ...]


class LayeredTable:
    """Rows of ``schema`` under ``path``, one for each value of ``key``; partitioned by ``partition`` within buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", partition: tuple[str, ...] = (), sort: tuple[str, ...] = (), looked_up: tuple[str, ...] = (), sketched: tuple[str, ...] = (), buckets: int = 16):
        self.spark, self.path, self.key, self.partition, self.sort, self.looked_up, self.sketched, self.buckets = spark, path.rstrip("/"), key, partition, sort, looked_up, sketched, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # --- the log ----------------------------------------------------------------------------------------------------------

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _files(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self._names("log") if name.endswith(".json") and not name.startswith(".")]

    def version(self, n: int | None = None) -> Version:
        """The current version, or an older one. A file that its writer has not finished is not there yet."""
        numbers = self.versions() if n is None else [n]
        for number in reversed(numbers):
            stream = self._files.open(self._at("log", f"{number:012d}.json"))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return Version(number, tuple(Layer(**x) for x in json.loads(text)["layers"]))
            except ValueError:
                continue
        raise FileNotFoundError(f"no version of {self.path}")

    def exists(self) -> bool:
        return bool(self.versions())

    def commit(self, since: Version | None, layers: tuple[Layer, ...]) -> Version:
        """Makes the version after ``since``, or raises Conflict if it is there."""
        n = 0 if since is None else since.n + 1
        try:
            out = self._files.create(self._at("log", f"{n:012d}.json"), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {n} of {self.path} was made by another writer") from None
            raise
        out.write(bytearray(json.dumps({"n": n, "layers": [vars(x) for x in layers]}), "utf-8"))
        out.close()
        return Version(n, layers)

    # --- layers -----------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, n: int, rows: DataFrame | None, gone: DataFrame | None, about: int | None = None) -> Layer:
        """rows: of the schema; gone: of the key, each once. about: how many rows, if not as many as keys."""
        name = f"layer-{n:012d}-{uuid.uuid4().hex[:8]}"
        by = ["bucket", *self.partition]
        taken = 0
        if gone is not None:
            gone.select(self.key, self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/gone")
            taken = self._gone(name).count()
        if rows is None:
            return Layer(name, 0, taken)
        rows = rows.select(*self.schema.names, self._bucket()).hint("rebalance", *by).sortWithinPartitions(*by, *self.sort)
        writer = rows.write.partitionBy(*by)
        about = (taken if about is None else about) // self.buckets
        for c in self.looked_up if about >= LOOKED_UP_ROWS else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(about))
        writer.parquet(f"{self.path}/{name}/rows")
        if self.sketched:
            # of what was written, and only the columns that count
            sketches = [F.hll_sketch_agg(F.col(c), F.lit(SKETCH_BITS)).alias(c) for c in self.sketched]
            self._rows(name).groupBy(*self.partition).agg(F.count(F.lit(1)).alias("n"), *sketches).coalesce(1).write.parquet(f"{self.path}/{name}/sketches")
        return Layer(name, self._rows(name).count(), taken)

    def _rows(self, name: str) -> DataFrame:
        return self._read(f"{name}/rows", *self.schema.fields)

    def _gone(self, name: str) -> DataFrame:
        return self._read(f"{name}/gone", self.schema[self.key])

    def _read(self, folder: str, *fields: StructField) -> DataFrame:
        return self.spark.read.schema(StructType([*fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/{folder}")

    def _merged(self, layers: tuple[Layer, ...], where: Column | None = None) -> DataFrame:
        """The rows of a stack of layers. where: on the key and the bucket, for both rows and keys taken away."""
        kept = (lambda df: df) if where is None else (lambda df: df.filter(where))
        rows = [kept(self._rows(x.name)).withColumn("__layer", F.lit(i)) for i, x in enumerate(layers) if x.rows]
        gone = [kept(self._gone(x.name)).withColumn("__layer", F.lit(i)) for i, x in enumerate(layers) if x.gone and i]
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, rows)
        if not gone:
            return rows.select(*self.schema.names)
        keys = sum(x.gone for x in layers[1:])
        gone = reduce(DataFrame.unionByName, gone)

        def live(rows: DataFrame, gone: DataFrame, small: bool) -> DataFrame:
            last = gone.groupBy(F.col(self.key).alias("__key")).agg(F.max("__layer").alias("__gone"))
            joined = rows.join(F.broadcast(last) if small else last, F.col(self.key) == F.col("__key"), "left")
            return joined.filter(F.coalesce("__gone", F.lit(-1)) <= F.col("__layer")).select(*self.schema.names)

        if keys <= BROADCAST_KEYS or keys > BROADCAST_KEYS * self.buckets:
            return live(rows, gone, keys <= BROADCAST_KEYS)
        in_bucket = [live(rows.filter(F.col("bucket") == b), gone.filter(F.col("bucket") == b), True) for b in range(self.buckets)]
        return reduce(DataFrame.unionByName, in_bucket)

    def read(self, n: int | None = None) -> DataFrame:
        """The rows of the current version, or of an older one that has not been removed."""
        return self._merged(self.version(n).layers)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; other buckets are not read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        buckets = [r[0] for r in asked.select(self._bucket()).distinct().collect()]
        return self._merged(self.version().layers, F.col("bucket").isin(buckets) & F.col(self.key).isin(list(keys)))

    def distinct(self, *by: str) -> DataFrame:
        """by and an estimate of the different values of each sketched column, from the sketches of all layers; no rows are
        read. Values that a change took away count until the layers are folded. by: partition columns."""
        layers = [x for x in self.version().layers if x.rows]
        kinds = ", ".join(f"`{c}` {self.schema[c].dataType.simpleString()}" for c in self.partition)
        schema = f"{kinds}, n long, " + ", ".join(f"`{c}` binary" for c in self.sketched)
        found = self.spark.read.schema(schema).parquet(*(f"{self.path}/{x.name}/sketches" for x in layers)) if layers else self.spark.createDataFrame([], schema)
        return found.groupBy(*by).agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in self.sketched))

    # --- changes ----------------------------------------------------------------------------------------------------------

    def reset(self) -> None:
        """A version without rows, whatever was there."""
        self.commit(self.version() if self.exists() else None, ())

    def change(self, rows: DataFrame | None, gone: DataFrame | None, since: Version | None = None) -> Layer:
        """Adds a layer: keys taken away, and rows (whose keys have to be among them, each once). since: the version that the
        change was made from; if another one has come since then, it raises Conflict."""
        since = self.version() if since is None else since
        layer = self._write(since.n + 1, rows, gone)
        if not layer.rows and not layer.gone:
            self._files.delete(self._at(layer.name), True)
            return layer
        try:
            now = self.commit(since, (*since.layers, layer))
        except Conflict:
            self._files.delete(self._at(layer.name), True)
            raise
        above = sum(x.rows + x.gone for x in now.layers[1:])
        if len(now.layers) > MOST_LAYERS or (len(now.layers) > 1 and above > FOLD_SHARE * max(now.layers[0].rows, 1) and len(now.layers) > MOST_LAYERS // 2):
            self.compact(whole=above > FOLD_SHARE * now.layers[0].rows)
        return layer

    def compact(self, whole: bool = True) -> None:
        """Folds all layers into one, or those above the lowest one. Another writer's change in between wins."""
        now = self.version()
        low = 0 if whole else 1
        stack = now.layers[low:]
        if len(stack) < 2:
            return
        gone = None
        if low and any(x.gone for x in stack):
            gone = reduce(DataFrame.unionByName, [self._gone(x.name) for x in stack if x.gone]).select(self.key).distinct()
        layer = self._write(now.n + 1, self._merged(stack), gone, sum(x.rows for x in stack))
        try:
            self.commit(now, (*now.layers[:low], layer))
        except Conflict:
            self._files.delete(self._at(layer.name), True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last versions, and the layers that only they have. Layers of writers at work are newer. Gives the
        names of what is gone."""
        numbers = self.versions()
        kept = [self.version(n) for n in numbers[-keep:]]
        used = {x.name for v in kept for x in v.layers}
        removed = [name for name in self._names() if name.startswith("layer-") and name not in used and int(name.split("-")[1]) <= kept[-1].n]
        for name in removed:
            self._files.delete(self._at(name), True)
        for n in numbers[:-keep]:
            self._files.delete(self._at("log", f"{n:012d}.json"), False)
        return removed

    def drop(self) -> None:
        """Removes the folder; nothing happens if it is not there."""
        self._files.delete(self._at(), True)
