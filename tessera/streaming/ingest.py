"""Structured Streaming: incremental re-indexing, event windows, sessions and conversation state. (None of it is needed for
batch parity; results equal the batch forms on the same rows.)"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.store import ChunkStore


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def reindex(chunks: DataFrame, store: ChunkStore, checkpoint: str):
    """Upserts each micro-batch; a later row of an id wins. Started queries stop when all files that are there are read."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out of closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def recent_turns(turns: DataFrame, max_history: int = 10) -> DataFrame:
    """conv_id, turn, history (the last 2 * max_history turns so far, as role: text lines) of each arriving turn."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for r in rows.itertuples():
            held = [*held, f"{r.role}: {r.text}"][-2 * max_history :]
            out.append((key[0], r.turn, "\n".join(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, history string", "held array<string>", "append", GroupStateTimeout.NoTimeout)
