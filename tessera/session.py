"""Session with the settings that the plans expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is left to the cluster or given in ``conf``."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share. Without one a local session gets a
    folder of this machine; on a cluster, where executors could not share that, it is an error."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows, else as it is, for a shuffled join. df: small or checkpointed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
