"""Latent spaces: SVD projection of sparse views, CCA, significance thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import normal_cdf
from ..session import materialize


def svd_projection(features: DataFrame, key: str, feature: str, value: str, dims: int = 16) -> DataFrame:
    """Rows of a sparse table scaled to length 1, projected on the leading singular vectors, scaled again.

    Features are hashed to 1,024 columns, so the driver holds a matrix of that size only.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = 1024
    cells = features.groupBy(F.col(key).alias("id"), F.pmod(F.xxhash64(feature), F.lit(width)).cast("int").alias("c")).agg(F.sum(value).cast("double").alias("x"))
    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("m"))
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, v: s + v * v))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(F.array(F.try_element_at("m", i)), 0), F.lit(0.0)) / norm)
    x = rows.select("id", array_to_vector(dense).alias("v"))
    y = PCA(k=dims, inputCol="v", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("p"))
    length = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, v: s + v * v))
    return y.select(F.col("id").alias(key), F.transform("p", lambda v: F.when(length > 0, v / length).otherwise(0.0)).alias("vec"))


def canonical_correlations(a: np.ndarray, b: np.ndarray, k: int = 10) -> np.ndarray:
    """Canonical correlations of two small matrices with the same rows."""
    q = []
    for m in (a, b):
        u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        q.append(u[:, s > 1e-10 * max(s.max(), 1e-300)])
    return np.clip(np.linalg.svd(q[0].T @ q[1], compute_uv=False)[:k], 0, 1)


def collinearity_verdict(mean: float) -> str:
    return "redundant" if mean > 0.70 else "complementary" if mean < 0.40 else "partial"


def significance_threshold(counts: DataFrame, score: str = "score", alpha: float = 0.05, method: str = "bonferroni") -> DataFrame:
    """One row ``(tau, n_significant)``: the least score that is significant against all scores' mean and deviation.

    ``counts`` has each score once, with the number ``n`` of pairs that have it. Without a significant score the 85th
    percentile stands in.
    """
    from pyspark.sql import Window

    x = F.col(score)
    c = materialize(counts.select(x.alias("x"), F.col("n").alias("c")), "scores")
    mean = c.agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mu"), F.sum("c").alias("n"))
    gap = F.col("x") - F.col("mu")
    s = c.crossJoin(F.broadcast(mean)).groupBy("mu", "n").agg(F.sqrt(F.sum(gap * gap * F.col("c")) / F.sum("c")).alias("sd"))  # one row
    p85 = c.agg(F.percentile("x", 0.85, F.col("c")).alias("p85"))
    t = c.crossJoin(F.broadcast(s)).withColumn("p", 1 - normal_cdf(gap / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1e300)))  # one row
    if method == "bonferroni":
        hit = t.where(F.col("p") * F.col("n") <= alpha)
    else:  # Benjamini-Hochberg: the greatest p with p <= alpha * rank / n; a row per distinct p is ranked
        per = t.where(F.col("p") <= alpha).groupBy("p", "n").agg(F.sum("c").alias("c"))
        ranked = per.withColumn("r", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
        cut = ranked.where(F.col("p") <= alpha * F.col("r") / F.col("n")).agg(F.max("p").alias("cut"))
        hit = t.crossJoin(F.broadcast(cut)).where("p <= cut")  # one row
    got = hit.agg(F.min("x").alias("least"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_significant"))
    return got.crossJoin(F.broadcast(p85)).select(F.round(F.coalesce("least", "p85"), 6).alias("tau"), "n_significant")  # one row


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a Pearson correlation, by the normal limit of Fisher's z."""
    if n < 4 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    return math.erfc(abs(math.atanh(r)) * math.sqrt(n - 3) / math.sqrt(2))
