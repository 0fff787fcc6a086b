"""Pairwise similarity as edge tables ``(a, b, ...)`` with ``a < b``.

Jaccard goes through the inverted index: only pairs that share a feature meet. Dense pairs are computed
strip by strip (see ``strips``), so nothing is cross-joined row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import strips


def set_jaccard(features: DataFrame, key: str, feature: str) -> DataFrame:
    """Pairs sharing a feature: ``(a, b, overlap, union, score)``. Rows of ``features`` count once."""
    f = features.select(F.col(key).alias("k"), F.col(feature).alias("f")).distinct()
    size = f.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    left, right = f.withColumnRenamed("k", "a"), f.withColumnRenamed("k", "b")
    both = left.join(right, "f").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    sized = both.join(size.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return sized.select("a", "b", "overlap", union.alias("union"), (F.col("overlap") / union).alias("score"))


def jaccard_at_least(features: DataFrame, key: str, feature: str, least: float) -> DataFrame:
    """Pairs ``a < b`` of Jaccard ``least`` or more: ``(a, b, overlap, score)``, without loss and without the common features.

    Sets of n features that reach it share one of the ``n - ceil(least n) + 1`` rarest of either, so only those meet; sizes
    that are too far apart don't. Candidates are verified on the whole sets. Equal sets are one node while pairs are
    sought, so a feature that only copies share is met once. The place of a shared feature in the two sets bounds what they
    can share in all, which leaves few candidates.
    """
    sets = features.select(F.col(key).alias("k"), F.col(feature).alias("f")).groupBy("k").agg(F.array_sort(F.collect_set("f")).alias("s"))
    own = materialize(sets.withColumn("node", F.sha2(F.to_json("s"), 256)), "sets")
    nodes = own.groupBy("node").agg(F.first("s").alias("s"), F.first(F.size("s")).alias("n"))
    each = nodes.select("node", "n", F.explode("s").alias("f"))
    known = each.join(each.groupBy("f").agg(F.count(F.lit(1)).alias("df")), "f")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "f"))
    head = materialize(known.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("node", "n", "f", "place"), "heads")
    left, right = (head.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}"), "f") for c in "xy")
    # all sets are in one order, so features they share lie before the shared one in both, or after it in both
    most = F.least("px", "py") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    enough = (F.least("nx", "ny") >= least * F.greatest("nx", "ny") - 1e-9) & (most >= least / (1 + least) * (F.col("nx") + F.col("ny")) - 1e-9)
    met = left.join(right, "f").where((F.col("x") < F.col("y")) & enough).select("x", "y").distinct()
    full = met.join(nodes.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x").join(nodes.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
    over = full.select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("overlap"), (F.size("sx") + F.size("sy")).alias("all"))
    same = nodes.select(F.col("node").alias("x"), F.col("node").alias("y"), F.col("n").cast("long").alias("overlap"), (2 * F.col("n")).alias("all"))
    good = over.unionByName(same).withColumn("score", F.round(F.col("overlap") / (F.col("all") - F.col("overlap")), 6)).where(F.col("score") >= least)
    p, q = own.select(F.col("node").alias("x"), F.col("k").alias("p")), own.select(F.col("node").alias("y"), F.col("k").alias("q"))
    pairs = good.join(p, "x").join(q, "y").where((F.col("x") < F.col("y")) | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "overlap", "score")


def dot(x: Column, y: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine, clamped; 0 for an empty, missing or zero vector."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    value = F.greatest(F.least(dot(x, y) / norms, F.lit(1.0)), F.lit(-1.0))
    return F.when(F.coalesce(F.size(x), F.lit(0)) * F.coalesce(F.size(y), F.lit(0)) == 0, F.lit(0.0)).when(norms == 0, F.lit(0.0)).otherwise(value)


def _unit(frame: pd.DataFrame) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=float) for v in frame["v"]])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dense_pairs(vectors: DataFrame, key: str, vec: str, above: float = -2.0) -> DataFrame:
    """Cosine of all pairs ``a < b`` with ``cosine > above``: ``(a, b, score)``, rounded to 6 digits."""
    return strips.pairs(strips.vectors_of(vectors, key, vec), above)


def dense_neighbours(vectors: DataFrame, key: str, vec: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest by cosine of every vector, or of those of ``queries``, itself excluded: ``(query_id, doc_id, score, rank)``;
    ties by the smaller id."""
    return strips.nearest(strips.vectors_of(vectors, key, vec), k, None if queries is None else strips.vectors_of(queries, key, vec))


#: Rows that the cells of ``cell_neighbours`` are fitted on, by hash order (a bounded sample), and rows of a cell's block.
CELL_SAMPLE, CELL_BLOCK = 20_000, 4096


def cell_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, cells: int | None = None, share: float = 0.4, seed: int = 42) -> DataFrame:
    """Approximate k nearest by cosine for the rows of ``queries``: ``(query_id, doc_id, score, rank)``, itself excluded.

    Cells are the k-means cells of a bounded sample; every vector lies in its cell, and a query looks into that ``share`` of them that
    is nearest. A cell is dealt into blocks of some ``CELL_BLOCK`` rows, so a hot cell is many tasks; each block sends its k best. The
    exact form is ``dense_neighbours``; recall against it is a matter of ``share`` and of how clustered the vectors are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .retrieval import top_k

    src = vectors.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    n = src.count()
    some = src.orderBy(F.xxhash64("k"), "k").limit(CELL_SAMPLE)
    size = cells or max(2, min(1024, int(n**0.5 / 2)))
    look = max(1, min(size, round(size * share)))
    fitted = KMeans(k=size, seed=seed, maxIter=10).setDistanceMeasure("cosine").fit(some.select(array_to_vector("v").alias("features")))
    centres = np.array([c / (np.linalg.norm(c) or 1.0) for c in fitted.clusterCenters()])  # at most 1,024 rows

    def nearest(width: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    order = np.argsort(-(_unit(f) @ centres.T), axis=1, kind="stable")[:, :width]
                    yield pd.DataFrame({"k": f["k"].repeat(width).to_numpy(), "v": f["v"].repeat(width).to_numpy(), "cell": order.ravel().astype("int32")})

        return run

    placed = src.mapInPandas(nearest(1), "k long, v array<double>, cell int")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).drop("blocks")  # a row per cell
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).mapInPandas(nearest(look), "k long, v array<double>, cell int")
    sent = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values("k")
        out, ids, unit = [], right["k"].to_numpy(), _unit(right)
        for at in range(0, len(left), 1024):
            q = left.iloc[at : at + 1024]
            s = np.round(np.clip(_unit(q) @ unit.T, -1, 1), 6) + 0.0
            order = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            pair = pd.DataFrame({"query_id": np.repeat(q["k"].to_numpy(), order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(s, order, axis=1).ravel()})
            out.append(pair[pair["query_id"] != pair["doc_id"]])
        return pd.concat(out)

    near = sent.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(best, "query_id long, doc_id long, score double")
    return top_k(near, k)


def fuse(sparse: Column, dense: Column, has_both: Column, w_sparse: float = 0.7) -> Column:
    """``0.7 sparse + 0.3 dense``; the sparse score alone if a vector is missing."""
    return F.when(has_both, w_sparse * sparse + (1 - w_sparse) * dense).otherwise(sparse)


def dual_jaccard(tokens: DataFrame, grams: DataFrame, key: str, token: str, gram: str, above: float = 0.05) -> DataFrame:
    """Mean of two Jaccard scores, kept if strictly above the threshold."""
    t = set_jaccard(tokens, key, token).select("a", "b", F.col("score").alias("s1"))
    g = set_jaccard(grams, key, gram).select("a", "b", F.col("score").alias("s2"))
    mean = (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))) / 2
    return t.join(g, ["a", "b"], "full_outer").select("a", "b", F.round(mean, 6).alias("score")).where(F.col("score") > above)


def row_correlation(rows: DataFrame, key: str, column: str, value: str, n_columns: int, above: float = 0.1) -> DataFrame:
    """Pearson correlation of sparse rows (missing cells are 0), pairs that share a cell only, ``r > above``."""
    r = rows.select(F.col(key).alias("k"), F.col(column).alias("c"), F.col(value).alias("x"))
    s = r.groupBy("k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    both = r.withColumnRenamed("k", "a").join(r.select(F.col("k").alias("b"), "c", F.col("x").alias("y")), "c").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    m = both.join(s.select(F.col("k").alias("a"), F.col("s").alias("sa"), F.col("ss").alias("ssa")), "a").join(s.select(F.col("k").alias("b"), F.col("s").alias("sb"), F.col("ss").alias("ssb")), "b")
    n = F.lit(float(n_columns))
    va, vb = F.col("ssa") - F.col("sa") * F.col("sa") / n, F.col("ssb") - F.col("sb") * F.col("sb") / n
    corr = (F.col("xy") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb)
    return m.where((va > 1e-9) & (vb > 1e-9)).select("a", "b", F.round(corr, 6).alias("r")).where(F.col("r") > above)
