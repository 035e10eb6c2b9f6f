"""Helpers that the text operators share: byte batches, row ids, checkpoints."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of fixed-width rows may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000
#: Text bytes that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 2_000_000

SPLITS = "spark.sql.files.minPartitionNum"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Parts of names of logical operators after which a second run may deliver other rows in a partition, or in another order.
MOVING = ("Aggregate", "Join", "Limit", "Repartition", "Sample", "Sort", "Window")


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Adds an id for each row. It is the same in each scan of the same files, so it may link two scans of one table;
    repeated or null document ids do not disturb it.

    How files are cut into partitions depends on the cores that are there, unless ``spark.sql.files.minPartitionNum`` is set;
    so it is set here once, and an executor lost between two scans does not move a row to another id. A table whose plan
    moves rows may come in another order the next time: see ``settled``."""
    spark = df.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, spark.sparkContext.defaultParallelism)
    return df.withColumn(name, F.monotonically_increasing_id())


def settled(df: DataFrame) -> DataFrame:
    """The table itself if each run of its plan delivers the same rows in the same order (scans of files, checkpoints, local
    rows, and what works on single rows), else a written copy. Operators call it once on their input before they number
    its rows more than once."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names, left = [], [plan]
    while left:
        node = left.pop()
        names.append(node.nodeName())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return written(df) if any(m in n for n in names for m in MOVING) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors share. Where it is unset, a folder of this machine, for local
    sessions only: on a cluster other machines could not read it, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, so that a lost executor costs nothing. For narrow tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a compressed table in the shared folder. For large tables; they stay until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffle files, broadcasts and plans that nothing refers to any more are given up now. Spark removes them when the driver
    collects garbage; a driver that runs many small jobs may not come to that for long, and keeps memory and disk so far."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a checkpointed table has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def joinable(df: DataFrame, rows: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
    """The table with a broadcast hint if a count of it allows that, else as it is, for a shuffled join. Of a table with a
    column of lists their elements are counted, too."""
    fits = small(df, rows)
    if fits and lists:
        fits = df.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0] <= rows
    return F.broadcast(df) if fits else df


def fold(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task, after which the allocators give back what they keep. Spark reuses Python workers, so what one
    task has freed would otherwise stay with the worker through all later stages."""

    @functools.wraps(work)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts as one array, and where each begins and the last ends. Null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, one at a time; null is empty."""
    raw, at = utf8(column)
    view = memoryview(np.ascontiguousarray(raw))
    for i in range(len(at) - 1):
        yield bytes(view[at[i] : at[i + 1]])
