"""Retrieval quality, votes and judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: hits / k (even if fewer were retrieved) and hits / min(relevant, k).

    ``ranked`` is ``(query_id, doc_id, rank)``, ``relevant`` is ``(query_id, doc_id)``.
    """
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    j = total.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("query_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.col("hits") / F.least("total", F.lit(k)), 6).alias("recall"))


def category_precision_recall(ranked: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The same where a document is relevant if it has the query's label; the query itself isn't counted."""
    size = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total"))
    q = labels.select(F.col("id").alias("query_id"), "label").join(size, "label")
    d = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("dl"))
    hits = ranked.where(F.col("rank") <= k).join(d, "doc_id").join(q.select("query_id", "label"), "query_id").where("dl = label").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    j = q.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("query_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.when(F.col("total") > 0, F.col("hits") / F.least("total", F.lit(k))).otherwise(0.0), 6).alias("recall"))


def mrr(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """One row: mean reciprocal rank of the first hit within k."""
    hit = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def composite(systems: DataFrame) -> DataFrame:
    """Per system: mean of precision, recall and min-max normalised BM25. Input ``(system, precision, recall, bm25)``."""
    w = Window.partitionBy()
    mean = systems.groupBy("system").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("bm25").alias("bm25"))
    norm = (F.col("bm25") - F.min("bm25").over(w)) / (F.max("bm25").over(w) - F.min("bm25").over(w) + 1e-9)
    scored = mean.withColumn("norm", norm)
    return scored.select("system", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round((F.col("precision") + F.col("recall") + F.col("norm")) / 3, 6).alias("composite"))


def votes(verdicts: DataFrame, group: str) -> DataFrame:
    """Mean score, pass by two thirds, agreement, issues, and the decision."""
    n, p = F.count(F.lit(1)), F.count_if("passed")
    per = verdicts.groupBy(group).agg(
        F.avg("score").alias("mean_score"), n.alias("n"), p.alias("n_passed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues")
    )
    agree = F.greatest(F.col("n_passed"), F.col("n") - F.col("n_passed")) / F.col("n")
    ok = F.col("n_passed") >= F.col("n") * 0.66
    return per.select(group, F.round("mean_score", 6).alias("mean_score"), ok.alias("passed"), F.round(agree, 6).alias("agreement"), "issues", F.when(ok, "ACCEPT").when(agree < 0.5, "ESCALATE").otherwise("REVISE").alias("decision"))


def judge_mean(metrics: list[Column], digits: int = 4) -> Column:
    total = metrics[0]
    for m in metrics[1:]:
        total = total + m
    return F.bround(total / len(metrics), digits)


def regressions(before: DataFrame, now: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases that passed before and fail now."""
    return before.where("passed").select(case).intersect(now.where("NOT passed").select(case))


def slice_rates(results: DataFrame) -> DataFrame:
    """Per tag: cases, pass rate, mean score."""
    return results.select(F.explode("tags").alias("tag"), "passed", "score").groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )


def rank_fit(ranked: DataFrame, wanted: DataFrame, k: int = 8) -> DataFrame:
    """Per query: ``1 / rank`` of the wanted document within k, whether it is there, and their mean."""
    hit = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    j = wanted.select("query_id").distinct().join(hit, "query_id", "left")
    p, r = F.coalesce(1 / F.col("r"), F.lit(0.0)), F.col("r").isNotNull().cast("double")
    return j.select("query_id", F.round(p, 6).alias("precision"), r.alias("recall"), F.round((p + r) / 2, 6).alias("fit"))
