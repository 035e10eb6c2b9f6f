"""Event windows, sessions and counters of visits as batch queries (the streaming forms give the same rows), beyond the reference's operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.retrieval import table
from tessera.streaming import counters, ingest


def events_windows(spark, sf_dir):
    out = ingest.windows(table(spark, sf_dir, "events"), "6 hours")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


def events_sessions(spark, sf_dir):
    out = ingest.sessions(table(spark, sf_dir, "events"), "12 hours")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def visit_counters(spark, sf_dir):
    """Views count as questions, and the number in the properties as the sources that were shown."""
    events = table(spark, sf_dir, "events")
    shown = F.get_json_object("props", "$.k").cast("long")
    return counters.counted(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("row_id"), "ts", (F.col("event_type") == "view").alias("question"), shown.alias("sources")), "6 hours")


QUERIES = {f.__name__: f for f in (events_windows, events_sessions, visit_counters)}
ORACLES = {
    "events_windows": "SELECT epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'))::bigint AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL '12 hours') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "visit_counters": """WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS begins FROM events WHERE ts IS NOT NULL),
v AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id AS key, event_id AS row_id, epoch_us(ts) AS at, min(epoch_us(ts)) OVER w AS visit, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w::bigint AS questions, sum(coalesce(CAST(props->>'$.k' AS bigint), 0)) OVER w::bigint AS sources
FROM v WINDOW w AS (PARTITION BY user_id, n ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
}
