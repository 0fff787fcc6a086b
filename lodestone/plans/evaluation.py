"""Votes, judge scores, slices and system tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalmetrics as ev
from ..session import table
from .registry import query


@query(
    "vote_aggregation",
    """WITH v AS (SELECT l_orderkey AS g, l_discount AS score, l_returnflag <> 'R' AS ok FROM lineitem), a AS (SELECT g, avg(score) AS m, count(*) AS n, count(*) FILTER (ok) AS p FROM v GROUP BY 1),
i AS (SELECT l_orderkey AS g, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS issues FROM lineitem GROUP BY 1)
SELECT a.g, round(m, 6) AS mean_score, p >= n * 0.66 AS passed, round(greatest(p, n - p) / CAST(n AS DOUBLE), 6) AS agreement, issues, CASE WHEN p >= n * 0.66 THEN 'ACCEPT' WHEN greatest(p, n - p) / CAST(n AS DOUBLE) < 0.5 THEN 'ESCALATE' ELSE 'REVISE' END AS decision FROM a JOIN i ON a.g = i.g""",
)
def vote_aggregation(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_discount").alias("score"), (F.col("l_returnflag") != "R").alias("passed"), F.array("l_linestatus").alias("issues"))
    return ev.votes(v, "g").withColumn("issues", F.array_join("issues", ","))


@query("judge_means", "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax + l_quantity / 50.0 + l_discount * l_tax) / 4, 9) AS macro FROM lineitem")
def judge_means(spark, sf):
    m = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50.0, F.col("l_discount") * F.col("l_tax")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(sum(m[1:], m[0]) / 4, 9).alias("macro"))


@query("slice_rates", "SELECT tag, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM (SELECT unnest([l_returnflag, l_linestatus]) AS tag, l_discount > 0.03 AS ok, l_discount AS score FROM lineitem) GROUP BY 1")
def slice_rates(spark, sf):
    return ev.slice_rates(table(spark, sf, "lineitem").select(F.array("l_returnflag", "l_linestatus").alias("tags"), (F.col("l_discount") > 0.03).alias("passed"), F.col("l_discount").alias("score")))


@query(
    "system_composites",
    """WITH m AS (SELECT l_returnflag || l_linestatus AS system, avg(l_discount) AS p, avg(l_tax) AS r, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1)
SELECT system, round(p, 6) AS precision, round(r, 6) AS recall, round((p + r + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER () + 1e-9)) / 3, 6) AS composite FROM m""",
)
def system_composites(spark, sf):
    return ev.composite(table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("system"), F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"), F.col("l_extendedprice").alias("bm25")))


@query("exact_match", "SELECT o_orderkey, trim(o_orderpriority) = trim(' 1-URGENT ') AS hit FROM orders")
def exact_match(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.trim("o_orderpriority") == F.trim(F.lit(" 1-URGENT "))).alias("hit"))


@query(
    "proxy_lift",
    "WITH m AS (SELECT l_returnflag AS system, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1) SELECT system, round(a - b, 6) AS lift, round(a - avg(a) OVER (), 6) AS delta FROM m",
)
def proxy_lift(spark, sf):
    """Differences between two systems and from the mean."""
    from pyspark.sql import Window

    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return m.select("system", F.round(F.col("a") - F.col("b"), 6).alias("lift"), F.round(F.col("a") - F.avg("a").over(Window.partitionBy()), 6).alias("delta"))
