"""Deterministic sampling and batching: every draw is a hash of id and seed, so reruns agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def uniform(key: str, seed: int) -> Column:
    """Uniform in (0, 1) from MD5 of seed and id; the same in any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement by weight: least ``-ln(u) / w`` (a top-n feature)."""
    return df.withColumn("_e", -F.log(uniform(key, seed)) / weight).where(weight > 0).orderBy("_e", key).limit(n).drop("_e")


def even_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by a key that is unique: only keys are ranked, each part of the input sends n of them."""
    return df.join(F.broadcast(weighted_sample(df.select(key), key, F.lit(1.0), n, seed)), key, "left_semi")  # n keys


def largest_remainder_quotas(sizes: DataFrame, size: str, total: int, key: str) -> DataFrame:
    """Whole quotas in proportion to ``size``, at least 1 each while ``total`` lasts; ties by key."""
    w = Window.partitionBy()
    share = F.col(size) / F.sum(size).over(w) * total
    base = sizes.withColumn("quota", F.greatest(F.floor(share), F.lit(1)).cast("long")).withColumn("_rest", share - F.floor(share))
    left = F.lit(total) - F.sum("quota").over(w)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    return base.withColumn("quota", F.col("quota") + F.when(place <= left, 1).otherwise(0)).drop("_rest")


def cdf_quotas(scores: DataFrame, z: str, key: str, total: int) -> DataFrame:
    """Quotas from the differences of the normal CDF of sorted z values: rounded, 1 at least, trimmed from the largest.

    A row per stratum; the window is as small as their number.
    """
    from ..functions.scoring import normal_cdf

    w = Window.orderBy(z, key)
    step = normal_cdf(F.col(z)) - F.coalesce(F.lag(normal_cdf(F.col(z))).over(w), F.lit(0.0))
    share = scores.withColumn("_s", step).withColumn("_s", F.col("_s") / F.sum("_s").over(Window.partitionBy()))
    q = share.withColumn("quota", F.greatest(F.round(F.col("_s") * total), F.lit(1)).cast("long"))
    over = F.sum("quota").over(Window.partitionBy()) - total
    place = F.row_number().over(Window.orderBy(F.desc("quota"), key))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    # the excess is taken one by one from the largest, in turns
    cut = F.when(over > 0, F.floor(over / n) + F.when(place <= over % n, 1).otherwise(0)).otherwise(0)
    return q.withColumn("quota", F.greatest(F.col("quota") - cut, F.lit(1)).cast("long")).drop("_s")


def reject_resample(df: DataFrame, rates: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Each row stays with its class's probability, relative to the greatest one."""
    top = rates.agg(F.max("p").alias("_top"))
    return df.join(rates.select(by, "p"), by).crossJoin(F.broadcast(top)).where(uniform(key, seed) < F.col("p") / F.col("_top")).drop("p", "_top")  # one row


def stratified(df: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Each stratum's quota of rows, by hash order."""
    w = Window.partitionBy(stratum).orderBy(uniform(key, seed), key)
    return df.join(quotas.select(stratum, "quota"), stratum).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def softmax_rates(df: DataFrame, by: str, length: str, temperature: float = 1.0) -> DataFrame:
    """Per class: mean length, weight 1/mean, softmax of log weights."""
    per = df.groupBy(by).agg(F.avg(length).alias("mean_len"))
    e = F.exp(F.log(1 / F.col("mean_len")) / temperature)
    return per.select(by, F.round("mean_len", 6).alias("mean_len"), F.round(e / F.sum(e).over(Window.partitionBy()), 6).alias("p"))


def anchor_pack(df: DataFrame, key: str, size: str, budget: int, by: str) -> DataFrame:
    """Batches to a token budget, longest first: each batch takes ``max(1, budget // anchor)`` items.

    Items of size 0 or less are left out. One partition value (``by``) is packed by one task.
    """
    spec = f"{by} {df.schema[by].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, batch long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame[frame[size] > 0].sort_values([size, key], ascending=[False, True])
        sizes, batch, at, b = f[size].to_numpy(), np.zeros(len(f), dtype="int64"), 0, 0
        while at < len(f):
            take = max(1, int(budget // sizes[at]))
            batch[at : at + take] = b
            at, b = at + take, b + 1
        return pd.DataFrame({by: f[by], key: f[key], "batch": batch})

    return df.select(by, key, size).groupBy(by).applyInPandas(pack, spec)


def yeo_johnson_lambda(values: np.ndarray) -> float:
    """Maximum-likelihood lambda by golden section on [-2, 4]."""
    x = np.asarray(values, dtype=float)

    def transform(lam: float) -> np.ndarray:
        out = np.empty_like(x)
        pos = x >= 0
        out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-9 else ((x[pos] + 1) ** lam - 1) / lam
        out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-9 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
        return out

    def loss(lam: float) -> float:
        v = transform(lam).var()
        return len(x) / 2 * np.log(v if v > 0 else 1e-300) - (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    a, b, g = -2.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def idf_fidelity(full: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: share of tokens whose term the sample knows, and mean absolute IDF difference.

    Inputs are ``(doc_id, tokens)``.
    """
    from .retrieval import document_frequencies
    from ..functions.scoring import idf

    n, m = full.agg(F.count(F.lit(1)).alias("n")), sample.agg(F.count(F.lit(1)).alias("m"))
    a = document_frequencies(full).crossJoin(F.broadcast(n)).select("term", idf(F.col("n"), F.col("df")).alias("i1"))  # one row
    b = document_frequencies(sample).crossJoin(F.broadcast(m)).select("term", idf(F.col("m"), F.col("df")).alias("i2"))  # one row
    tokens = full.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_tokens"))
    j = tokens.join(a, "term").join(b, "term", "left")
    return j.agg(
        F.round(F.sum(F.when(F.col("i2").isNotNull(), F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens"), 6).alias("coverage"),
        F.round(F.avg(F.abs(F.col("i1") - F.col("i2"))), 6).alias("idf_mae"),
    )
