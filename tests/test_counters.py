"""Counters of visits: the stream, in any order of arrival, against the window over the same rows."""

import datetime as dt
import random

import pytest

from tessera.streaming import counters

SCHEMA = "key long, row_id long, ts timestamp, question boolean, sources int"
BEGIN = dt.datetime(2024, 1, 1)


def made(n=300, seed=4):
    rnd = random.Random(seed)
    return [(rnd.randrange(5), i, BEGIN + dt.timedelta(seconds=i * 97 + rnd.randrange(90)), rnd.choice([True, False, None]), rnd.choice([0, 1, 7, None])) for i in range(n)]


def plain(rows, idle):
    out, state = [], {}
    for key, i, ts, question, sources in sorted(rows, key=lambda r: (r[2], r[1])):
        at = int((ts - BEGIN).total_seconds() * 1e6) + int(BEGIN.replace(tzinfo=dt.UTC).timestamp() * 1e6)
        last, start, q, s = state.get(key, (None, 0, 0, 0))
        if last is None or at - last >= idle * 1e6:
            start, q, s = at, 0, 0
        state[key] = (at, start, q + bool(question), s + (sources or 0))
        out.append((key, i, *state[key]))
    return sorted(out)


def streamed(spark, folder, batches, name, idle, late):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = counters.counted_stream(read, idle, late).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_table_against_plain_loop(spark):
    rows = made()
    got = counters.counted(spark.createDataFrame(rows, SCHEMA), "5 minutes")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 300)
    assert counters.counted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nulls_and_ties(spark):
    rows = [(None, 2, BEGIN, True, None), (None, 1, BEGIN, None, 3), (1, 3, None, True, 1), (None, 4, BEGIN + dt.timedelta(minutes=5), True, 1)]
    got = sorted((r.row_id, r.questions, r.sources) for r in counters.counted(spark.createDataFrame(rows, SCHEMA), "5 minutes").collect())
    assert got == [(1, 0, 3), (2, 1, 3), (4, 1, 1)]


@pytest.mark.parametrize("idle", ["5 minutes", "20 minutes"])
def test_stream_equals_table(spark, tmp_path, idle):
    rows = made()
    rnd = random.Random(1)
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        rnd.shuffle(b)
    batches[1][0], batches[2][0] = batches[2][0], batches[1][0]  # some arrive a batch later or sooner
    last = [(99, 10_000, BEGIN + dt.timedelta(days=9), True, 1)]  # lets the watermark pass all others
    got = streamed(spark, str(tmp_path / "rows"), [*batches, last], f"v{idle[0]}", idle, "4 hours")
    want = sorted(tuple(r) for r in counters.counted(spark.createDataFrame(rows, SCHEMA), idle).collect())
    assert got == want and len({r[3] for r in got}) > 5
