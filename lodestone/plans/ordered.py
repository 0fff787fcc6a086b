"""Ordered analytics over ``events``, ``conversations`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import signals, stats
from ..session import table
from .registry import query


@query("ema_macd", None)
def ema_macd(spark, sf):
    """MACD of event values per user; the triggers alone have an SQL form (a recursive fold)."""
    return signals.macd(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select(
        "user_id", "ts", "event_id", F.round("macd", 6).alias("macd"), F.round("signal", 6).alias("signal"), F.round("hist", 6).alias("hist"), "trigger"
    )


@query(
    "ema_last",
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
e AS (SELECT user_id, k, CAST(value AS DOUBLE) AS x FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.2 * o.value + 0.8 * e.x FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
SELECT user_id, count(*) AS n, round(max_by(x, k), 6) AS ema FROM e GROUP BY user_id""",
)
def ema_last(spark, sf):
    """Last EMA (alpha 0.2) of each user's event values."""
    e = signals.ema(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", {"x": 9.0})
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("x", F.struct("ts", "event_id")), 6).alias("ema"))


@query(
    "fixed_step_values",
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
q AS (SELECT user_id, k, 0.5 + 0.1 * (value - 0.5) AS q FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, q.q + 0.1 * (o.value - q.q) FROM q JOIN o ON o.user_id = q.user_id AND o.k = q.k + 1)
SELECT user_id, count(*) AS n, round(max_by(q, k), 6) AS q FROM q GROUP BY user_id""",
)
def fixed_step_values(spark, sf):
    """Learned value of each user's events: a step of 0.1 towards each new one, from 0.5."""
    return signals.fixed_step(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 0.1, 0.5).withColumn("q", F.round("q", 6))


@query(
    "streaks",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type AS value, min(ts) AS start, count(*) AS length FROM x GROUP BY user_id, event_type, g HAVING count(*) >= 4""",
)
def streaks(spark, sf):
    return signals.streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), 4)


@query("stalls", "SELECT * FROM (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) WHERE gap > 100000")
def stalls(spark, sf):
    return signals.stalls(table(spark, sf, "events"), "user_id", "ts", 100_000)


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def sessions(spark, sf):
    return signals.sessions(table(spark, sf, "events"), "user_id", "ts")


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    "transition_matrix",
    "WITH t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), n AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT src, dst, n, round(n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE), 6) AS p FROM n",
)
def transition_matrix(spark, sf):
    return signals.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "role_transitions",
    "WITH t AS (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations), n AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT src, dst, n, round(n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE), 6) AS p FROM n",
)
def role_transitions(spark, sf):
    return signals.transitions(table(spark, sf, "conversations"), "conv_id", ["turn"], "role")


@query("running_mean", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS q FROM events")
def running_mean(spark, sf):
    return signals.running_mean(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", F.round("q", 9).alias("q"))


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf):
    from ..operators.stores import latest

    return latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    "rate_of_change",
    "SELECT event_id, CASE WHEN dt > 0 THEN round(dv / dt, 6) END AS rate FROM (SELECT event_id, value - lag(value) OVER w AS dv, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))",
)
def rate_of_change(spark, sf):
    return signals.rate_of_change(table(spark, sf, "events"), "user_id", "ts", "value").select("event_id", F.round("rate", 6).alias("rate"))


@query(
    "duration_outliers",
    "WITH m AS (SELECT user_id, median(value) AS m, count(*) AS n FROM events GROUP BY 1), s AS (SELECT e.user_id, m, n, 1.4826 * median(abs(value - m)) AS mad FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1, 2, 3) SELECT event_id, e.user_id, value FROM events e JOIN s ON e.user_id = s.user_id WHERE n >= 3 AND value > m + 3 * mad",
)
def duration_outliers(spark, sf):
    return signals.duration_outliers(table(spark, sf, "events"), "user_id", "value").select("event_id", "user_id", "value")


@query(
    "rolling_limits",
    """WITH p AS (SELECT event_id, user_id, list(CASE WHEN value > 0 THEN ln(value) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS past FROM events),
a AS (SELECT event_id, list_sort(list_filter(past, lambda v: v IS NOT NULL)) AS s FROM p),
b AS (SELECT event_id, s, (s[CAST(floor((len(s) - 1) / 2) AS BIGINT) + 1] + s[CAST(floor(len(s) / 2) AS BIGINT) + 1]) / 2 AS med FROM a),
c AS (SELECT event_id, s, med, list_sort(list_transform(s, lambda v: abs(v - med))) AS d FROM b),
e AS (SELECT event_id, s, med, (d[CAST(floor((len(d) - 1) / 2) AS BIGINT) + 1] + d[CAST(floor(len(d) / 2) AS BIGINT) + 1]) / 2 AS mad FROM c)
SELECT event_id, CASE WHEN len(s) >= 5 AND mad > 0 THEN round(exp(med + 2 * mad), 6) END AS watch, CASE WHEN len(s) >= 5 AND mad > 0 THEN round(exp(med + 4 * mad), 6) END AS kill FROM e""",
)
def rolling_limits(spark, sf):
    return signals.rolling_limits(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "watch", "kill")


@query("percent_rank_weights", "SELECT event_id, round((row_number() OVER (ORDER BY ts, event_id) - 1) / CAST((SELECT count(*) FROM events) - 1 AS DOUBLE), 6) AS w FROM events")
def percent_rank_weights(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    numbered = stats.global_row_number(e, ["ts", "event_id"], "k")
    return numbered.crossJoin(F.broadcast(n)).select("event_id", F.round((F.col("k") - 1) / (F.col("n") - 1), 6).alias("w"))  # one row


@query("rolling_splits", "SELECT user_id, s.start, s.start + 20 AS test_from, s.start + 25 AS test_to FROM (SELECT user_id, unnest(range(0, n - 25 + 1, 5)) AS start FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n >= 25) s")
def rolling_splits(spark, sf):
    """Train on 20 events, test on 5, step 5, per user."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    starts = n.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 25, F.lit(5).cast("long"))).alias("start"))
    return starts.select("user_id", "start", (F.col("start") + 20).alias("test_from"), (F.col("start") + 25).alias("test_to"))


@query("second_difference", "SELECT d, n, lead(n, 2) OVER (ORDER BY d) - 2 * lead(n) OVER (ORDER BY d) + n AS bend FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)")
def second_difference(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("d")  # a row per day
    return d.select("d", "n", (F.lead("n", 2).over(w) - 2 * F.lead("n").over(w) + F.col("n")).alias("bend"))


@query("heartbeats", "SELECT user_id, max(ts) AS last_seen, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def heartbeats(spark, sf):
    """Idempotent heartbeat: the latest time of each key."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    "repeated_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS line, pos FROM l), f AS (SELECT * FROM k WHERE length(line) >= 40),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS g FROM f)
SELECT doc_id, min(pos) AS start, count(*) AS length FROM g GROUP BY doc_id, line, g HAVING count(*) >= 2""",
)
def repeated_lines(spark, sf):
    """Verbatim repeats of normalised long lines, twice or more in a row."""
    l = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    k = l.withColumn("line", F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))).where("length(line) >= 40").withColumn("pos", F.col("pos").cast("long"))
    return signals.streaks(k, "doc_id", ["pos"], F.col("line"), 2).drop("value")


@query("interval_states", "SELECT a.user_id, date_trunc('day', TIMESTAMP '2024-01-15') AS at, a.event_type AS state FROM (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS until FROM events) a WHERE ts <= TIMESTAMP '2024-01-15' AND (until IS NULL OR TIMESTAMP '2024-01-15' < until)")
def interval_states(spark, sf):
    """As-of: the state of each user at a moment, from intervals with an open end."""
    from ..operators.stores import daily_states, interval_at

    e = table(spark, sf, "events")
    s = daily_states(e, "user_id", "ts", "event_type")
    moments = e.select("user_id").distinct().withColumn("at", F.to_timestamp(F.lit("2024-01-15")))
    return interval_at(s, moments, "user_id", "at").select("user_id", "at", "state")
