"""Streams over ``events``, drained and compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ev
from .registry import query


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return ev.run_now(ev.windowed(ev.event_stream(spark, sf))).withColumn("total", F.round("total", 4))


@query("stream_sliding", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    return ev.run_now(ev.windowed(ev.event_stream(spark, sf), "2 hours", "1 hour")).withColumn("total", F.round("total", 4))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark, sf):
    return ev.run_now(ev.session_counts(ev.event_stream(spark, sf)))


@query("stream_heartbeats", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1")
def stream_heartbeats(spark, sf):
    return ev.run_now(ev.heartbeats(ev.event_stream(spark, sf)))


@query("stream_queue_states", "SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_queue_states(spark, sf):
    return ev.run_now(ev.queue_states(ev.event_stream(spark, sf)))


@query("stream_submissions", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_submissions(spark, sf):
    """One submission a (key, type): all events of one file come in one batch."""
    return ev.run_now(ev.first_submissions(ev.event_stream(spark, sf)).select("user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_stalls", "SELECT user_id, ts, round(gap, 3) AS gap FROM (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) WHERE gap > 100000")
def stream_stalls(spark, sf):
    return ev.run_now(ev.stall_alerts(ev.event_stream(spark, sf)), "append").withColumn("gap", F.round("gap", 3))


@query(
    "stream_streaks",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) AS k FROM x) SELECT user_id, ts, event_type FROM k WHERE k = 4""",
)
def stream_streaks(spark, sf):
    return ev.run_now(ev.repeat_streaks(ev.event_stream(spark, sf)), "append")
