"""Robust statistics: median and MAD, interval filters, bins and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SCALE = 1.4826


def exact_quantiles(df: DataFrame, value: Column | str, qs: list[float]) -> list[float | None]:
    """Exact interpolated quantiles of a column over all rows, as numbers; None for no values.

    A single aggregate would hold every distinct value in one task. Here values are counted in parallel and
    sorted by ranges; only the row counts of the ranges and the wanted values come to the driver.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(v.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "values")
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy("p").agg(F.sum("n").alias("n")).collect())  # a row per range
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(qs)
    before, at = {}, 0
    for p, n in sizes:
        before[p], at = at, at + n
    places = [q * (total - 1) for q in qs]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, total - 1) for x in places})
    home = {r: max(p for p in before if before[p] <= r) for r in ranks}
    starts = F.coalesce(*[F.when(F.col("p") == p, F.lit(before[p])) for p in sorted(set(home.values()))])
    some = ranged.where(F.col("p").isin(sorted(set(home.values()))))
    upto = starts + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(*[F.lit(r) for r in ranks])
    hit = some.withColumn("upto", upto).withColumn("ranks", F.filter(wanted, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).where("size(ranks) > 0")
    found = {r: row["v"] for row in hit.select("v", "ranks").collect() for r in row["ranks"]}  # at most two values a quantile
    out = []
    for x in places:
        lo, hi = found[int(x)], found[min(int(x) + 1, total - 1)]
        out.append(lo + (hi - lo) * (x - int(x)))
    return out


def global_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 in a total order over all rows, without one task that sees them all.

    Ranges are sorted in parallel; each adds the rows of the ranges before it (a row per range).
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_before")  # a row per range


def median_mad(df: DataFrame, value: str, by: list[str] | None = None, floor: float | None = None) -> DataFrame:
    """Median and scaled MAD of ``value`` (per group). ``floor`` replaces a zero MAD."""
    if not by:
        median, mad = median_mad_values(df, value, floor)
        return df.sparkSession.createDataFrame([(median, mad)], "median double, mad double")
    known = df.where(F.col(value).isNotNull())
    med = known.groupBy(*by).agg(F.median(value).alias("median"))
    mad = F.median(F.abs(F.col(value) - F.col("median"))) * SCALE
    if floor is not None:
        mad = F.when(mad == 0, F.lit(floor)).otherwise(mad)
    return known.join(med, by).groupBy(*by, "median").agg(mad.alias("mad"))


def median_mad_values(df: DataFrame, value: str, floor: float | None = None) -> tuple[float | None, float | None]:
    """Median and scaled MAD over all rows, as numbers."""
    median = exact_quantiles(df, value, [0.5])[0]
    if median is None:
        return None, None
    mad = exact_quantiles(df, F.abs(F.col(value) - median), [0.5])[0] * SCALE
    return median, (floor if floor is not None and mad == 0 else mad)


def interval_filter(df: DataFrame, value: str, z: float = 1.96, floor: float | None = None) -> DataFrame:
    """Rows within ``median ± z * MAD`` (inclusive), with the bounds. The bounds are literals, so they reach the scan."""
    median, mad = median_mad_values(df, value, floor)
    lower, upper = (None, None) if median is None else (median - z * mad, median + z * mad)
    inside = df.where(F.col(value).between(F.lit(lower), F.lit(upper)))
    return inside.withColumns({"lower": F.lit(lower).cast("double"), "upper": F.lit(upper).cast("double")})


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins between interpolated percentiles, ``edge[i-1] <= x < edge[i]``, numbered from 0."""
    edges = [e for e in exact_quantiles(df, value, [i / bins for i in range(1, bins)]) if e is not None]
    above = [(F.col(value) >= e).cast("int") for e in edges]
    return df.withColumn(name, sum(above[1:], above[0]) if above else F.lit(0))


def median_sides(df: DataFrame, value: str, key: str, chunks: int = 4) -> DataFrame:
    """Equal-count chunks on each side of the median (a side takes its larger chunks first)."""
    median = exact_quantiles(df, value, [0.5])[0]
    sided = df.withColumn("side", F.when(F.col(value) <= F.lit(median), "low").otherwise("high"))
    return ranked_chunks(sided, ["side"], value, key, chunks)


def ranked_chunks(df: DataFrame, by: list[str], value: str, key: str, chunks: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value, key)
    return df.withColumn("chunk", F.ntile(chunks).over(w).cast("long"))


def percentile_threshold(df: DataFrame, score: str, q: float = 0.85, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """One row: the percentile, clamped."""
    x = exact_quantiles(df, score, [q])[0]
    return df.sparkSession.createDataFrame([(None if x is None else min(max(x, low), high),)], "tau double")


def cdf_steps(df: DataFrame, cdf: Column, by: str, key: str) -> DataFrame:
    """Differences of consecutive CDF values in the order of ``by``; the first is its own value."""
    w = Window.orderBy(by, key)
    return df.withColumn("cdf", cdf).withColumn("step", F.col("cdf") - F.lag("cdf", 1, 0.0).over(w))


def softmax_weights(df: DataFrame, weight: str, temperature: float) -> DataFrame:
    """``softmax(ln(w) / T)`` over all rows of a small table."""
    e = F.exp(F.log(weight) / temperature)
    total = df.agg(F.sum(e).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("p", e / F.col("_total")).drop("_total")
