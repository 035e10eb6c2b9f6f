"""A kept index of vectors by cells: lists on disk, one folder for each centre, of which a question reads those that it probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import build_cells, measured_probes, probes_for, search_cells


class CellIndex:
    """Vectors under ``path``: ``lists`` partitioned by cell, ``probes``, the number of cells that a question probes, and
    ``centres``, which are written last: without them there is no index."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector_col = spark, path.rstrip("/"), id_col, vector_col

    def exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/centres/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def create(self, vectors: DataFrame, sample_rows: int = 50_000, lists: int | None = None) -> bool:
        """Fits centres on a bounded sample, indexes every row that has a direction, and measures on a sample of questions how
        many cells have to be probed. Nothing happens, and it gives False, if the index is there."""
        if self.exists():
            return False
        celled, centres = build_cells(vectors.select(self.id_col, self.vector_col), self.id_col, self.vector_col, sample_rows, lists)
        self._write(celled, "overwrite")
        probes = measured_probes(self.read(), centres, id_col=self.id_col, vector_col=self.vector_col)
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        rows = [(i, c) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        return True

    def centres(self) -> list[list[float]]:
        """At most a thousand, by their rule."""
        return [r.centre for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()]

    def probes(self) -> int:
        """As measured; by the rule for an index that was made before this was kept."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/probes/_SUCCESS")
        kept = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.parquet(f"{self.path}/probes").first()[0] if kept else probes_for(len(self.centres()))

    def read(self) -> DataFrame:
        """id, vector, cell of all rows."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def _write(self, celled: DataFrame, mode: str) -> None:
        celled.select(self.id_col, self.vector_col, "cell").hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/lists")

    def add(self, vectors: DataFrame) -> None:
        """New vectors go to the nearest centres; there is no new fit. Their ids have to be new."""
        centres = np.array(self.centres())

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, centres.shape[1])
                size = np.linalg.norm(x, axis=1)
                there = np.flatnonzero(size > 0)
                unit = x[there] / size[there, None]
                cell = np.argmin((centres**2).sum(axis=1) - 2 * unit @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(there)) for c in b.columns), pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        rows = vectors.filter(F.col(self.vector_col).isNotNull()).select(self.id_col, self.vector_col)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._write(rows.mapInArrow(cells, f"{kinds}, cell int"), "append")

    def probed(self, questions: DataFrame, probes: int | None = None) -> DataFrame:
        """The rows of the cells that some question (qid, vector) probes; other folders are not read."""
        centres = np.array(self.centres())
        number = self.probes() if probes is None else probes

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, centres.shape[1])
                cells = np.unique(np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :number])
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32))], names=["cell"])

        asked = questions.select(F.col(questions.columns[1]).cast("array<double>")).mapInArrow(nearest, "cell int").distinct()
        return self.read().filter(F.col("cell").isin([r[0] for r in asked.collect()]))  # as many as centres at most

    def search(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, id, similarity, rank) of the best k rows in the probed cells of each question (qid, vector)."""
        probes = self.probes() if probes is None else probes
        return search_cells(self.probed(questions, probes), self.centres(), questions, k, probes, id_col=self.id_col, vector_col=self.vector_col)
