"""Clustering and agreement: centroids, k-means, silhouette, BSS/TSS, ARI, NMI, entropy, divergence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def coordinates(vectors: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(vectors: DataFrame, key: str, vec: str, label: str, unit: bool = True) -> DataFrame:
    """Mean vector per label, as long rows ``(label, dim, c)``; of length 1 if ``unit``."""
    mean = coordinates(vectors, key, vec, label).groupBy("label", "dim").agg(F.avg("x").alias("c"))
    if not unit:
        return mean
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return mean.join(norm, "label").select("label", "dim", F.when(F.col("norm") > 0, F.col("c") / F.col("norm")).otherwise(0.0).alias("c"))


def intra_distances(vectors: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Euclidean distance of each vector to the mean of its label."""
    x = coordinates(vectors, key, vec, label)
    c = centroids(vectors, key, vec, label, unit=False)
    return x.join(c, ["label", "dim"]).groupBy("id", "label").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))), 6).alias("distance"))


def bss_tss(vectors: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """One row: share of the total sum of squares that lies between the labels."""
    x = coordinates(vectors, key, vec, label)
    per = x.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    dims = per.groupBy("dim").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    tss = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    bss = F.sum(F.col("between") - F.col("s") * F.col("s") / F.col("n"))
    return dims.agg(F.round(F.when(tss > 0, bss / tss).otherwise(0.0), 6).alias("bss_tss"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    t = contingency(df, a, b)
    two = lambda c: c * (c - 1) / 2
    cells = t.agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    ra = t.groupBy("la").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    cb = t.groupBy("lb").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    one = cells.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(cb))  # one row each
    expected = F.col("rows") * F.col("cols") / two(F.col("total"))
    top = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("cells") - expected) / (top - expected)), 6).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """NMI with the arithmetic mean of the entropies."""
    t = contingency(df, a, b)
    total = t.agg(F.sum("n").alias("total"))
    ra = t.groupBy("la").agg(F.sum("n").alias("na"))
    cb = t.groupBy("lb").agg(F.sum("n").alias("nb"))
    j = t.join(ra, "la").join(cb, "lb").crossJoin(F.broadcast(total))
    mi = j.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda f, c: f.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h_{c}"))
    one = mi.crossJoin(F.broadcast(h(ra, "na"))).crossJoin(F.broadcast(h(cb, "nb")))  # one row each
    mean = (F.col("h_na") + F.col("h_nb")) / 2
    return one.select(F.round(F.when(mean > 0, F.col("mi") / mean).otherwise(1.0), 6).alias("nmi"))


def entropy(df: DataFrame, group: str, label: str) -> DataFrame:
    """``-sum p ln p`` of the labels in each group."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    return n.join(total, group).groupBy(group).agg(F.round(-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total"))), 6).alias("entropy"))


def divergence(df: DataFrame, group: str, label: str) -> DataFrame:
    """KL divergence of each group's label shares from the shares of all rows."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    base = n.groupBy(label).agg(F.sum("n").alias("q"))
    every = n.agg(F.sum("n").alias("every"))
    p = n.join(total, group).join(base, label).crossJoin(F.broadcast(every))  # one row
    return p.groupBy(group).agg(F.round(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total") / (F.col("q") / F.col("every")))), 6).alias("kl"))


def kmeans(vectors: DataFrame, key: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """``(key, cluster)`` by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(F.col(key), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def lloyd(m: np.ndarray, k: int, seed: int, rounds: int = 10, tolerance: float = 1e-4, rows: int = 4096) -> float:
    """Within-cluster cost of k-means: starts by distance (k-means++), then at most so many rounds; ``m`` stays as it is."""
    rng = np.random.default_rng(seed + k)
    centres = np.zeros((k, m.shape[1]))
    size = np.einsum("ij,ij->i", m, m, dtype=float)
    near = np.full(len(m), np.inf)
    for i in range(k):
        mass = np.cumsum(near) if i else np.arange(1.0, len(m) + 1)
        at = min(int(np.searchsorted(mass, rng.random() * mass[-1], "right")), len(m) - 1)
        centres[i] = m[at]
        near = np.minimum(near, np.maximum(size - 2 * (m @ m[at]) + size[at], 0))

    def assign() -> tuple[np.ndarray, float]:
        c = centres.astype(m.dtype)
        half = (np.einsum("ij,ij->i", centres, centres) / 2).astype(m.dtype)
        own, cost = np.empty(len(m), "int64"), 0.0
        for at in range(0, len(m), rows):
            part = m[at : at + rows]
            own[at : at + rows] = np.argmax(part @ c.T - half, axis=1)
            gap = part - centres[own[at : at + rows]]
            cost += float(np.einsum("ij,ij->", gap, gap))
        return own, cost

    for _ in range(rounds):
        own, _ = assign()
        order = np.argsort(own, kind="stable")
        some, start, n = np.unique(own[order], return_index=True, return_counts=True)
        new = centres.copy()
        new[some] = np.add.reduceat(m[order], start, axis=0, dtype=float) / n[:, None]
        moved = np.linalg.norm(new - centres, axis=1).max()
        centres = new
        if moved <= tolerance:
            break
    return assign()[1]


def elbow(vectors: DataFrame, key: str, vec: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """Within-cluster cost for k = 2 .. ceil(sqrt n) and its second difference; ``elbow`` marks the sharpest bend.

    The numbers of clusters are dealt over the tasks, each of which holds all vectors (in their own precision).
    """
    from pyspark.sql import Window

    kind = vectors.schema[vec].dataType.simpleString()
    src = vectors.select((F.col(vec) if kind in ("array<float>", "array<double>") else F.col(vec).cast("array<double>")).alias("v"))
    top = most or max(2, math.ceil(math.sqrt(src.count())))
    parts = max(16, 3 * vectors.sparkSession.sparkContext.defaultParallelism)
    ks = {s: list(range(2 + s, top + 1, 2 * parts)) + list(range(2 + 2 * parts - 1 - s, top + 1, 2 * parts)) for s in range(parts)}  # there and back: even shares

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            s, v = batch.column("s").to_numpy(), batch.column("v")
            for one in np.unique(s):
                part = v.filter(pa.array(s == one))
                held.setdefault(int(one), []).append(part.flatten().to_numpy().reshape(len(part), -1))
        for s, blocks in held.items():
            m = np.concatenate(blocks)
            blocks.clear()
            for k in ks[s]:
                yield pa.RecordBatch.from_arrays([pa.array([k], "int32"), pa.array([lloyd(m, k, seed)])], names=["k", "cost"])

    used = F.array(*[F.lit(s) for s in range(parts) if ks[s]])
    dealt = src.select(F.explode(used).alias("s"), "v").repartitionById(parts, F.col("s"))
    costs = materialize(dealt.mapInArrow(fit, "k int, cost double"), "costs")
    w = Window.orderBy("k")
    t = costs.withColumn("bend", F.lag("cost").over(w) - 2 * F.col("cost") + F.lead("cost").over(w))
    return t.withColumn("elbow", F.col("bend") == F.max("bend").over(Window.partitionBy()))


def silhouette(means: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean silhouette from each row's mean distance ``(u, lv, d)`` to the others of each label, and ``(id, label)``."""
    per = means.join(labels.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u")
    ab = per.groupBy("u").agg(F.max(F.when(F.col("lu") == F.col("lv"), F.col("d"))).alias("x"), F.min(F.when(F.col("lu") != F.col("lv"), F.col("d"))).alias("y"))
    s = F.when(F.col("x").isNull() | F.col("y").isNull(), 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y"))
    return ab.agg(F.round(F.avg(s), 6).alias("silhouette"))


def hashed_vectors(weights: DataFrame, key: str, term: str, weight: str, width: int = 1024) -> DataFrame:
    """Sparse rows ``(key, term, weight)`` as dense vectors of ``width`` hashed columns: ``(key, vec)``."""
    cells = weights.groupBy(key, F.pmod(F.xxhash64(term), F.lit(width)).cast("int").alias("c")).agg(F.sum(weight).cast("double").alias("x"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("m"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def kmeans_restarts(vectors: DataFrame, key: str, vec: str, k: int, restarts: int = 3, seed: int = 42) -> DataFrame:
    """The k-means of least cost of several starts, ``k`` at most the number of rows: ``(key, cluster)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(F.col(key), array_to_vector(F.col(vec).cast("array<double>")).alias("features")).cache()
    fits = [KMeans(k=max(2, min(k, x.count())), seed=seed + i, maxIter=20).fit(x) for i in range(restarts)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return best.transform(x).select(key, F.col("prediction").alias("cluster"))


def gaussian_mixture(vectors: DataFrame, key: str, vec: str, k: int, seed: int = 42) -> DataFrame:
    """Soft clusters by a Gaussian mixture: ``(key, cluster, confidence)``."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.select(F.col(key), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    got = GaussianMixture(k=k, seed=seed, maxIter=30).fit(x).transform(x)
    return got.select(key, F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("confidence"))


def composite_score(silhouette: DataFrame, bss_tss: DataFrame) -> DataFrame:
    """``0.5 (silhouette + 1) / 2 + 0.5 bss_tss`` of two one-row tables."""
    both = silhouette.crossJoin(F.broadcast(bss_tss))  # one row each
    return both.select(F.round(0.5 * (F.col("silhouette") + 1) / 2 + 0.5 * F.col("bss_tss"), 6).alias("score"))


def explained_variance(vectors: DataFrame, vec: str, dims: int) -> DataFrame:
    """Variance of the columns projected on the leading directions over that of all columns: one row ``(dims, explained)``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.select(F.col(vec).cast("array<double>").alias("vec"), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    y = PCA(k=dims, inputCol="v", outputCol="p").fit(x).transform(x).select("vec", vector_to_array("p").alias("p"))

    def total(column: str) -> DataFrame:
        return y.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias(f"all_{column}"))

    return total("p").crossJoin(F.broadcast(total("vec"))).select(F.lit(dims).alias("dims"), F.round(F.when(F.col("all_vec") > 0, F.col("all_p") / F.col("all_vec")).otherwise(0.0), 6).alias("explained"))  # one row each
