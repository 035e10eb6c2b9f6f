"""Running counters of visits: questions asked and sources shown so far, over a stream with keyed state and over a table.

A visit is a run of a key's rows without a pause of ``idle``. The stream keeps rows in a list until the watermark has
passed them, so the order of arrival does not matter; timers let them go in the order of their time, and one more timer
ends a visit, after which nothing is kept of its key. The table form is a window over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTED = "key long, row_id long, at long, visit long, questions long, sources long"
STORE = "spark.sql.streaming.stateStore.providerClass"


def _micros(text: str) -> int:
    """Microseconds of "3 hours" and the like."""
    return int(pd.Timedelta(text).value // 1000)


def counted(rows: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """rows: key, row_id, ts, question (boolean), sources (number shown). For each row, with ``at`` in microseconds: when its
    visit began, and how many questions and sources the visit has had, this row included. Rows of one time are in the order of
    their ids. A null question counts as none, null sources as 0; a row without a time belongs to no visit and is left out.
    Rows without a key are one key's."""
    timed = rows.filter("ts IS NOT NULL").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    order = Window.partitionBy("key").orderBy("at", "row_id")
    begins = F.coalesce(F.col("at") >= F.lag("at").over(order) + _micros(idle), F.lit(True))
    visits = timed.withColumn("number", F.sum(begins.cast("long")).over(order))
    so_far = Window.partitionBy("key", "number").orderBy("at", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return visits.select(
        "key", "row_id", "at", F.first("at").over(so_far).alias("visit"), F.sum(F.coalesce(F.col("question").cast("long"), F.lit(0))).over(so_far).alias("questions"),
        F.sum(F.coalesce(F.col("sources").cast("long"), F.lit(0))).over(so_far).alias("sources"),
    )


class _Counters(StatefulProcessor):
    """State of a key: rows that wait for the watermark, and (last time, start, questions, sources) of its open visit."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row_id long, question long, sources long")
        self.visit = handle.getValueState("visit", "last long, start long, questions long, sources long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in b[["at", "row_id", "question", "sources"]].itertuples(index=False, name=None)]
        self.waiting.appendList([tuple(int(x) for x in r) for r in new])
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        last, start, questions, sources = tuple(self.visit.get()) if self.visit.exists() else (None, 0, 0, 0)
        out = []
        for at, row_id, question, shown in ready:
            if last is None or at >= last + self.idle:
                start, questions, sources = at, 0, 0
            last, questions, sources = at, questions + question, sources + shown
            out.append((key[0], row_id, at, start, questions, sources))
        if ready:
            self.visit.update((last, start, questions, sources))
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(later[0][0])
        elif last is not None and last + self.idle > passed:
            self._wake(last + self.idle)
        elif last is not None:  # a row that comes now begins a visit of its own
            self.visit.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")])

    def close(self) -> None:
        pass


def counted_stream(rows: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same of a stream: a row comes out when the watermark has passed its time; rows that arrive behind the watermark are
    left out. What is kept of a key is its rows of the last ``late`` and four numbers, and nothing once a visit is over.

    The session gets the state store that lists and timers need."""
    rows.sparkSession.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL").withWatermark("ts", late)
    shaped = timed.select("key", "row_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("question").cast("long"), F.lit(0)).alias("question"), F.coalesce(F.col("sources").cast("long"), F.lit(0)).alias("sources"))
    return shaped.groupBy("key").transformWithStateInPandas(_Counters(_micros(idle)), COUNTED, "Append", "EventTime")
