"""The chunk table: upsert, delete, lookups, statistics, and an approximate vector index.

A store is a stack of Parquet layers and a log of versions, so a path being read is never overwritten and a change costs its
own rows. The functions on DataFrames do the same to a whole table.
"""

from __future__ import annotations

import math

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.layers import LayeredTable, Version
from tessera.session import bounded, checkpointed

CHUNK_SCHEMA = (
    "id string, content string, embedding array<float>, language string, chunk_type string, file_path string, start_line int, end_line int, "
    "class_name string, method_name string, documentation string, references array<string>, metadata string, created_at timestamp"
)


def latest(new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``, without that column."""
    return new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n", order)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq", created: str | None = "created_at") -> DataFrame:
    """old without the keys of new, and for each key of new its last row by ``order``, which keeps the old creation time."""
    last = latest(new, key, order)
    kept = old.join(last.select(key), key, "left_anti")
    if created and created in old.columns:
        first = old.select(key, F.col(created).alias("__created"))
        last = last.join(first, key, "left").withColumn(created, F.coalesce("__created", created)).drop("__created")
    return kept.unionByName(last.select(*kept.columns))


def delete_by_file(chunks: DataFrame, path: str, column: str = "file_path") -> DataFrame:
    return chunks.filter(~F.coalesce(F.col(column) == path, F.lit(False)))


def delete_by_prefix(chunks: DataFrame, prefix: str, column: str = "file_path") -> DataFrame:
    """The prefix is taken literally, without wildcards."""
    return chunks.filter(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def stats(chunks: DataFrame, *columns: str, distinct: str = "file_path") -> DataFrame:
    """(grouping, value, n, files): counts by each column and over all, in one pass of grouping sets. Null is a group."""
    sets = [[c] for c in columns] + [[]]
    grouped = chunks.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("files"), F.grouping_id().alias("gid"))
    bits = {(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    grouping = F.lit("total")
    value = F.lit(None).cast("string")
    for gid, c in bits.items():
        grouping = F.when(F.col("gid") == gid, c).otherwise(grouping)
        value = F.when(F.col("gid") == gid, F.col(c).cast("string")).otherwise(value)
    return grouped.select(grouping.alias("grouping"), value.alias("value"), "n", "files")


def class_chunk(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.filter((F.col("class_name") == name) & (F.col("chunk_type") == "class")).orderBy("id").limit(1)


def chunks_of_class(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.filter(F.col("class_name") == name).orderBy("start_line", "id")


def list_classes(chunks: DataFrame, language: str | None = None) -> DataFrame:
    found = chunks.filter(F.col("chunk_type") == "class")
    found = found if language is None else found.filter(F.col("language") == language)
    return found.orderBy("language", "class_name", "id")


def chunks_like(chunks: DataFrame, text: str, k: int = 50) -> DataFrame:
    """Chunks with a text in their class name or path: class_name, chunk_type, file_path, size, parent_class (of the metadata)."""
    found = chunks.filter(F.contains("class_name", F.lit(text)) | F.contains("file_path", F.lit(text)))
    return found.select("id", "class_name", "chunk_type", "file_path", F.length("content").alias("size"), F.get_json_object("metadata", "$.parent_class").alias("parent_class")).orderBy("chunk_type", "class_name", "id").limit(k)


def names_by(chunks: DataFrame, column: str) -> DataFrame:
    """(group, n, first): for each language or type its number of chunks and the first 100 names, sorted; null is a group."""
    name = F.coalesce("class_name", "file_path")
    place = F.row_number().over(Window.partitionBy(column).orderBy("name", "id"))
    few = chunks.select(column, "id", name.alias("name")).withColumn("place", place).filter("place <= 100")
    listed = few.groupBy(column).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("first"))
    counts = chunks.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(listed, counts[column].eqNullSafe(listed[column])).select(counts[column].alias("group"), "n", "first")


def known_classes(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_type") == "class").select("class_name").distinct()


class ChunkStore:
    """Chunks under ``path``, in layers: a change writes its own rows and the ids that it takes away, see ``LayeredTable``."""

    def __init__(self, spark: SparkSession, path: str, dims: int = 768, buckets: int = 16):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        self.table = LayeredTable(spark, path, CHUNK_SCHEMA, partition=("language", "chunk_type"), sort=("file_path", "start_line", "id"), looked_up=("id", "class_name"), sketched=("file_path", "class_name"), buckets=buckets)

    def create(self) -> None:
        """An empty store, whatever was there; older versions stay until ``vacuum``."""
        self.table.reset()

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def lookup(self, ids: list[str]) -> DataFrame:
        """The chunks of some ids."""
        return self.table.lookup(ids)

    def version(self) -> Version:
        """What a change can name as the version that it was made from."""
        return self.table.version()

    def upsert(self, chunks: DataFrame, since: Version | None = None) -> int:
        """chunks: the schema and ``seq``; a later row of an id wins and keeps the old creation time. The number of ids.
        Embeddings of another width and null ids are errors; so is a version that another writer has made since ``since``."""
        since = self.version() if since is None else since
        wrong = F.raise_error(F.lit(f"embedding without {self.dims} dimensions"))
        checked = chunks.withColumn("embedding", F.when(F.coalesce(F.size("embedding") == self.dims, F.lit(True)), F.col("embedding")).otherwise(wrong))
        checked = checked.withColumn("id", F.coalesce("id", F.raise_error(F.lit("chunk without an id"))))
        checked = checked.withColumn("references", F.when(F.size("references") > 0, F.col("references"))).withColumn("metadata", F.nullif("metadata", F.lit("{}")))
        last = latest(checked.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
        ids = checkpointed(last.select("id"))
        # of the old rows only ids and times are read, and of those only what the change replaces goes on
        first = self.table.read(since.n).select("id", F.col("created_at").alias("__created")).join(bounded(ids), "id", "left_semi")
        last = last.join(first, "id", "left").withColumn("created_at", F.coalesce("__created", "created_at")).drop("__created")
        return self.table.change(last, ids, since).rows

    def _delete(self, gone: DataFrame, since: Version) -> int:
        return self.table.change(None, gone.select("id"), since).gone

    def delete_by_file(self, path: str) -> int:
        """The number of chunks that are gone."""
        since = self.version()
        return self._delete(self.table.read(since.n).filter(F.col("file_path") == path), since)

    def delete_by_prefix(self, prefix: str) -> int:
        """The number of chunks that are gone. The prefix is taken literally."""
        since = self.version()
        return self._delete(self.table.read(since.n).filter(F.startswith("file_path", F.lit(prefix))), since)

    def distinct(self, *by: str) -> DataFrame:
        """Estimates of the different files and classes by language or type, or both, or over all, without reading chunks."""
        return self.table.distinct(*by)

    def compact(self) -> None:
        self.table.compact()

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.table.vacuum(keep)

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def drop(self) -> None:
        """Removes the folder with all versions; nothing happens if it is not there."""
        self.table.drop()


# --- approximate index ---------------------------------------------------------------------------------------------------


#: Share of the nearest rows that the probed cells of measured questions have to hold (0.9 is asked for), and the questions.
RECALL, QUESTIONS = 0.94, 256


def lists_for(rows: int) -> int:
    return max(10, min(1000, rows // 1000))


def build_cells(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 50_000, lists: int | None = None):
    """(vectors with their cell, centres): k-means over at most ``sample_rows`` rows (of the smallest hashed ids); every row
    is indexed. Unit vectors, so that near means similar."""
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("__norm", norm).filter("__norm > 0").withColumn("__unit", array_to_vector(F.transform(vector_col, lambda x: x.cast("double") / F.col("__norm"))))
    sample = unit.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    model = KMeans(k=lists or lists_for(vectors.count()), seed=3, maxIter=10, featuresCol="__unit", predictionCol="cell").fit(sample)
    return model.transform(unit).drop("__unit", "__norm"), [c.tolist() for c in model.clusterCenters()]


def probes_for(lists: int) -> int:
    """A quarter of the cells and eight at least: where ``measured_probes`` begins."""
    return min(lists, max(8, -(-lists // 4)))


def measured_probes(celled: DataFrame, centres: list[list[float]], k: int = 10, recall: float = RECALL, asked: int = QUESTIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """How many cells to probe, measured: the k nearest rows of a bounded sample of rows (of the smallest hashed ids) by exact
    search over all, without themselves, and in which place of a question's cells each of them lies. So many cells are
    taken as hold ``recall`` of them; never less than ``probes_for``, which vectors with less structure outgrow."""
    least = probes_for(len(centres))
    sample = celled.orderBy(F.xxhash64(id_col), id_col).limit(asked).select(F.col(id_col).cast("long").alias("id"), vector_col).collect()
    if least == len(centres) or not sample:
        return least
    own = dict(enumerate(r[0] for r in sample))
    scores = search.vector_scores(celled.select(F.concat_ws(":", F.col(id_col).cast("long").cast("string"), F.col("cell").cast("string")).alias("row"), F.col(vector_col).alias("vector")), [(i, r[1]) for i, r in enumerate(sample)], k + 1, "row", "vector")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    near = scores.withColumn("place", place).filter(F.col("place") <= k + 1).select("qid", F.split("id", ":")[0].cast("long").alias("id"), F.split("id", ":")[1].cast("int").alias("cell")).collect()  # asked * (k + 1) at most
    order = np.argsort(-(np.array([r[1] for r in sample], np.float64) @ np.array(centres).T), axis=1, kind="stable")
    places = np.argsort(order, axis=1)
    needed = np.sort([places[r.qid, r.cell] + 1 for r in near if r.id != own[r.qid]])
    return max(least, int(needed[math.ceil(recall * len(needed)) - 1])) if len(needed) else least


def nearest_cells(centres: list[list[float]], question: list[float], probes: int) -> list[int]:
    score = np.array(centres) @ np.array(question)
    return [int(i) for i in np.argsort(-score, kind="stable")[:probes]]


def search_cells(celled: DataFrame, centres: list[list[float]], questions: DataFrame, k: int, probes: int | None = None, at_once: int = 20_000, part_rows: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, id, similarity, rank) of the best k rows in the probed cells of each question (qid, vector).

    Questions go to their cells as rows, a block of about ``at_once`` at a time, and meet the vectors of a cell there. A cell of
    more than ``part_rows`` vectors is several parts; its questions go to each of them. A task holds the questions of its part
    and streams the vectors past them. probes: by default so many as ``measured_probes`` says."""
    probes = measured_probes(celled, centres, k, id_col=id_col, vector_col=vector_col) if probes is None else probes
    qid, vector = questions.columns[:2]
    matrix = np.array(centres)
    sizes = F.broadcast(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")))  # a row for each centre

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, len(matrix[0]))
            cells = np.argsort(-(q @ matrix.T), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cells.ravel().astype(np.int32))], names=["id", "vector", "cell"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, asked = None, [], []
        for b in batches:
            place, own = np.stack([b.column(c).to_numpy() for c in ("cell", "part", "kind")], axis=1), b.column("id").to_numpy()
            x = np.array(b.column("vector").to_pylist(), np.float64).reshape(b.num_rows, -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1), True])
            for i, j in zip(edges, edges[1:], strict=False):
                if tuple(place[i, :2]) != now:
                    now, ids, asked = tuple(place[i, :2]), [], []
                if not place[i, 2]:
                    ids.append(own[i:j])
                    asked.append(x[i:j])
                elif asked:
                    names, score = np.concatenate(ids), np.round(x[i:j] @ np.concatenate(asked).T, 6)
                    best = []
                    for c in range(len(names)):
                        good = np.flatnonzero(~np.isnan(score[:, c]))
                        best.append(good[np.lexsort((own[i:j][good], -score[good, c]))[:k]])
                    row, column = np.concatenate(best), np.repeat(np.arange(len(names)), [len(x) for x in best])
                    yield pa.RecordBatch.from_arrays([pa.array(names[column]), pa.array(own[i:j][row]), pa.array(score[row, column])], names=["qid", "id", "similarity"])

    vectors = celled.join(sizes, "cell").select("cell", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")).cast("long")
    blocks, done = max(1, -(-questions.count() // at_once)), []
    for i in range(blocks):
        own = questions.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i) if blocks > 1 else questions
        asked = own.select(F.col(qid).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(route, "id long, vector array<double>, cell int")
        asked = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "vector")
        found = asked.unionByName(vectors).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id").mapInArrow(compare, "qid long, id long, similarity double")
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        done.append(checkpointed(found) if blocks > 1 else found)
    return reduce(DataFrame.unionByName, done)
