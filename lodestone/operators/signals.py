"""Ordered analytics over series and events: EMA, MACD, streaks, stalls, rolling limits, sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions, of a timestamp with or without a zone (then UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def ema(df: DataFrame, series: str, order: list[str], value: str, spans: dict[str, float]) -> DataFrame:
    """Exponential moving averages (``adjust=False``, alpha = 2 / (span + 1)), one pass per series."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keep = [series, *order, value]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` double" for n in spans)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(order)
        for name, span in spans.items():
            f[name] = f[value].ewm(span=span, adjust=False).mean()
        return f

    return df.select(*keep).groupBy(series).applyInPandas(run, schema)


def macd(df: DataFrame, series: str, order: list[str], value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal, histogram, and ``trigger`` where the histogram crosses zero."""
    line = ema(df, series, order, value, {"fast": fast, "slow": slow}).withColumn("macd", F.col("fast") - F.col("slow"))
    sig = ema(line, series, order, "macd", {"signal": signal})
    hist = sig.withColumn("hist", F.col("macd") - F.col("signal"))
    before = F.lag("hist").over(Window.partitionBy(series).orderBy(*order))
    cross = F.when((before <= 0) & (F.col("hist") > 0), "up").when((before >= 0) & (F.col("hist") < 0), "down")
    return hist.select(series, *order, "macd", "signal", "hist", cross.alias("trigger"))


def streaks(df: DataFrame, by: str, order: list[str], same: Column, least: int) -> DataFrame:
    """Runs of one value in a row, of at least ``least``: ``(by, value, start, length)``."""
    w = Window.partitionBy(by).orderBy(*order)
    x = df.withColumn("_v", same).withColumn("_new", F.coalesce((~F.col("_v").eqNullSafe(F.lag("_v").over(w))).cast("int"), F.lit(1)))
    x = x.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new"))).withColumn("_run", F.sum("_new").over(w))
    runs = x.groupBy(by, "_run").agg(F.first("_v").alias("value"), F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("_run")


def stalls(df: DataFrame, by: str, ts: str, limit: float) -> DataFrame:
    """Gaps over ``limit`` seconds between neighbouring events: ``(by, ts, gap)``."""
    w = Window.partitionBy(by).orderBy(ts)
    gap = seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
    return df.withColumn("gap", gap).where(F.col("gap") > limit).select(by, ts, "gap")


def sessions(df: DataFrame, by: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows per key: ``(by, start, n)``."""
    return df.groupBy(F.col(by), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("s.start").alias("start"), "n")


def rolling_limits(df: DataFrame, by: str, order: list[str], value: str, last: int = 50, least: int = 5) -> DataFrame:
    """From the last ``last`` earlier positive values: ``exp(median + 2 MAD)`` and ``exp(median + 4 MAD)`` of the logs.

    Null with fewer than ``least`` values or a zero MAD.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-last, -1)
    x = df.withColumn("_past", F.collect_list(F.when(F.col(value) > 0, F.log(value))).over(w))

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    x = x.withColumn("_med", median(F.col("_past"))).withColumn("_mad", median(F.transform("_past", lambda v: F.abs(v - F.col("_med")))))
    ok = (F.size("_past") >= least) & (F.col("_mad") > 0)
    return x.select(by, *order, value, F.when(ok, F.round(F.exp(F.col("_med") + 2 * F.col("_mad")), 6)).alias("watch"), F.when(ok, F.round(F.exp(F.col("_med") + 4 * F.col("_mad")), 6)).alias("kill"))


def transitions(df: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Counts and probabilities of one state following another."""
    nxt = F.lead(state).over(Window.partitionBy(by).orderBy(*order))
    n = df.select(F.col(state).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6))


def rate_of_change(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    dt = seconds(F.col(order)) - seconds(F.lag(order).over(w))
    return df.withColumn("rate", F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / dt))


def running_mean(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("q", F.avg(value).over(w))


def duration_outliers(df: DataFrame, by: str, value: str, least: int = 3) -> DataFrame:
    """Values over ``median + 3 MAD`` of their key, for keys with enough runs."""
    from .stats import median_mad

    s = median_mad(df, value, [by])
    n = df.groupBy(by).agg(F.count(value).alias("_runs"))
    return df.join(s, by).join(n, by).where((F.col("_runs") >= least) & (F.col(value) > F.col("median") + 3 * F.col("mad"))).drop("_runs")


def splits(n_rows: DataFrame, train: int, test: int, step: int, n: str = "n") -> DataFrame:
    """Rolling train and test windows over positions 0 .. n-1."""
    last = F.col(n) - F.lit(train + test)
    starts = n_rows.where(last >= 0).select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("start"))
    return starts.select("start", (F.col("start") + train).alias("test_from"), (F.col("start") + train + test).alias("test_to"))


def fixed_step(df: DataFrame, by: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """Last value of ``q += alpha (r - q)`` from ``start``: ``(by, n, q)``, as a weighted sum, so no series is held in memory."""
    w = Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])
    back = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_r"), (F.row_number().over(w) - 1).alias("_k"))
    keep = 1.0 - alpha
    q = F.lit(start) * F.pow(F.lit(keep), F.count(F.lit(1))) + F.sum(F.lit(alpha) * F.pow(F.lit(keep), F.col("_k")) * F.col("_r"))
    return back.groupBy(by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
