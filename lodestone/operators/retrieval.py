"""Retrieval: sparse and dense ranking, fusion, rerank formulas.

A retriever returns ``(query_id, doc_id, score, rank)``; all queries run in one plan. Scoring goes through
the inverted index: only terms of the queries are kept of the corpus, so the join's size is that of the
postings of query terms, and ranks come from a top-k window that Spark limits before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text as tx
from ..session import materialize


def tokens(df: DataFrame, key: str, text: str, name: str = "doc_id") -> DataFrame:
    """``(doc_id, tokens)`` with letter-run tokens; a null text has none."""
    return df.select(F.col(key).alias(name), tx.letter_runs(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best per query; ties by the smaller document id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), doc)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length. Input ``(doc_id, tokens)``."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, pool: DataFrame | None = None) -> DataFrame:
    """BM25 of every matching (query, document): ``(query_id, doc_id, score)``.

    ``docs`` is ``(doc_id, tokens)``, ``queries`` is ``(query_id, tokens)``; query terms count with their
    multiplicity. ``pool`` (documents like ``docs``) takes the place of the corpus for the statistics.
    """
    q = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = materialize(q.select("term").distinct(), "terms")
    post = query_postings(docs, terms)
    stats, df = _statistics(post if pool is None else query_postings(pool, terms))
    tf = post.where("term IS NOT NULL")
    weighed = df.crossJoin(F.broadcast(stats)).select("term", "avg_len", scoring.idf(F.col("n_docs"), F.col("df")).alias("idf"))  # stats: one row
    part = tf.join(weighed, "term").select(
        "doc_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("part")
    )
    return part.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("score"))


def query_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, len, term, tf)`` of the given terms, and for each document one row with a null term: one pass over the tokens."""
    # a range's size is known to the planner, so few terms are broadcast and many are not
    wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(None).cast("string"))).withColumnRenamed("term", "_t")
    each = docs.select("doc_id", F.size("tokens").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    return materialize(each.join(wanted, each["term"].eqNullSafe(wanted["_t"]), "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")


def _statistics(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number and mean length of all documents (one row), and document frequencies."""
    every = post.where("term IS NULL")
    return (
        every.agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len")),
        post.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")),
    )


def tfidf(docs: DataFrame, max_features: int = 8000) -> DataFrame:
    """``(doc_id, term, weight)``: sublinear tf, smoothed idf, unit length; the most frequent terms only."""
    tf = materialize(docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    vocab = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    w = tf.join(F.broadcast(vocab), "term").crossJoin(F.broadcast(n))  # max_features rows; one row
    raw = w.select("doc_id", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / norm).alias("weight"))


def sparse_cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot products of unit vectors ``(doc_id, term, weight)`` and ``(query_id, term, weight)`` through their terms."""
    q = queries.withColumnRenamed("weight", "qw")
    return vectors.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """``sum 1 / (k + rank)`` with ranks from 1."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings])
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def expanded_bm25(docs: DataFrame, expansions: DataFrame) -> DataFrame:
    """Sum of the BM25 scores of all expansions of a query (``query_id, tokens`` rows), positive ones only."""
    lone = materialize(expansions.withColumn("_q", F.monotonically_increasing_id()), "expansions")  # written once: the ids stay
    scored = bm25(docs, lone.select(F.col("_q").alias("query_id"), "tokens"))
    return scored.withColumnRenamed("query_id", "_q").join(lone.select("_q", "query_id"), "_q").groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")).where("score > 0")


def best_per_key(parts: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """Union that keeps the best row of each key; of equals the one of the earlier part."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(*key).orderBy(F.desc(score), "_part")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_part")


def composite_distance(z: Column, same_community: Column, avg_bm25: Column) -> Column:
    return 0.6 * F.abs(z) + 0.3 * (1 - same_community.cast("int")) + 0.1 / avg_bm25


def blended(sim: Column, q: Column, lam: float) -> Column:
    return (1 - lam) * sim + lam * q


def rank_relevance(rank: Column, n: Column) -> Column:
    """Falls linearly from 1.0 at rank 1 to 0.1 at the last rank."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(1.0 - 0.9 * (rank - 1) / (n - 1))


def cluster_budget(shares: DataFrame, cluster: str, score: str, total: int) -> DataFrame:
    """``1 + round(share * (total - clusters))`` results for each cluster of a query."""
    w = Window.partitionBy("query_id")
    n = F.count(F.lit(1)).over(w)
    share = F.col(score) / F.sum(score).over(w)
    return shares.select("query_id", cluster, score, (1 + F.round(share * F.greatest(F.lit(total) - n, F.lit(0)))).cast("int").alias("budget"))


def trigrams(word: str) -> set[str]:
    """Character trigrams of a word between two spaces; an empty word has none."""
    padded = f" {word} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def max_sims(words: list[str], others: list[str]) -> list[float]:
    """MaxSim: per word the greatest trigram Jaccard with one of the others (1 for an equal one), by an inverted index."""
    index: dict[str, list[int]] = {}
    sizes = []
    known = dict.fromkeys(others, 1.0)
    for i, other in enumerate(list(known)):
        grams = trigrams(other)
        sizes.append(len(grams))
        for t in grams:
            index.setdefault(t, []).append(i)
    for word in words:
        if word not in known:
            grams = trigrams(word)
            shared = Counter(i for t in grams for i in index.get(t, ()))
            known[word] = max((n / (len(grams) + sizes[i] - n) for i, n in shared.items()), default=0.0)
    return [known[w] for w in words]


def max_sim_column(words: Column, others: Column) -> Column:
    """``max_sims`` of two arrays of words."""

    @F.pandas_udf("array<double>")
    def sims(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([max_sims(list(a), list(b)) for a, b in zip(x, y, strict=True)])

    return sims(words, others)


def affinity_rows(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's row of the affinity matrix, columns in the order of the ids: ``(id, affinity)``; itself 1, no pair 0.

    ``pairs`` is ``(a, b, score)`` with ``a < b``. A row has as many cells as there are nodes: meant for a sample or a cluster.
    """
    every = nodes.select(F.col("id").alias("other"))
    columns = F.broadcast(every.agg(F.array_sort(F.collect_list("other")).alias("columns")))
    two = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(pairs.select("b", "a", "score")).union(nodes.select("id", "id", F.lit(1.0)))
    cells = two.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "score"))).alias("c"))
    found = F.transform("columns", lambda o: F.coalesce(F.try_element_at(F.map_from_entries("c"), o), F.lit(0.0)))
    row = F.when(F.size("c") == F.size("columns"), F.transform("c", lambda x: x.score)).otherwise(found)  # a search for each cell only where some are missing
    return cells.crossJoin(columns).select("id", row.alias("affinity"))  # one row


def cascade(lexical: DataFrame, dense: DataFrame, links: DataFrame, units: DataFrame, late: Callable[[DataFrame], DataFrame], first: int = 169, seeds: int = 144, final: int = 10) -> DataFrame:
    """The layered retrieval of ``(query_id, unit, score, rank)``.

    Lexical and dense rankings of ``first`` chunks each are fused by reciprocal ranks to ``seeds``; these are expanded over
    ``links (doc_id, other, score)`` and fused with the expansion; chunks become their ``units (doc_id, unit)``, each with its best
    chunk; units are scored anew by a late interaction, and the ``final`` best are kept: ``late`` takes the pairs ``(query_id, unit)`` and
    gives them with their score ``late``.
    """
    seed = materialize(top_k(reciprocal_rank_fusion([lexical.where(F.col("rank") <= first), dense.where(F.col("rank") <= first)]), seeds), "seeds")
    near = seed.select("query_id", "doc_id", F.col("score").alias("s")).join(links, "doc_id").groupBy("query_id", F.col("other").alias("doc_id")).agg(F.round(F.sum(F.col("s") * F.col("score")), 9).alias("score"))
    pool = reciprocal_rank_fusion([seed, top_k(near, seeds)])
    rebuilt = pool.join(units, "doc_id").select("query_id", "unit").distinct()
    return top_k(late(rebuilt).select("query_id", F.col("unit").alias("doc_id"), F.col("late").alias("score")), final)


def match_or_new(rows: DataFrame, known: DataFrame, scores: DataFrame, least: float = 0.85) -> DataFrame:
    """Each row's best partner in another collection from ``least`` on, or none: ``(id, match, score, is_new)``.

    ``scores`` is ``(id, other, score)``; ties go to the least id.
    """
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    best = scores.join(known.select(F.col("id").alias("other")), "other", "left_semi").where(F.col("score") >= least).withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select("id").join(best, "id", "left").select("id", F.col("other").alias("match"), "score", F.col("other").isNull().alias("is_new"))


def route_clusters(
    near: DataFrame, labels: DataFrame, centroids: DataFrame, vectors: DataFrame, seeds: int = 10, clusters: int = 3, total: int = 12, within: int = 20, backstop: int = 3, lam: float = 0.7
) -> DataFrame:
    """Soft cluster routing with a backstop: ``(query_id, doc_id, score, cluster)``.

    ``near`` is ``(query_id, doc_id, score)``, ``labels`` ``(doc_id, cluster)``, ``centroids`` ``(query_id, cluster, centroid_sim)``, ``vectors``
    ``(doc_id, vec)``. The ``seeds`` best documents of a query give their clusters a mass of positive scores; of the clusters with
    seeds, the best by ``0.7 centroid + 0.3 mass`` share the ``total``, one result each at least. Inside a cluster results are chosen by
    marginal relevance among its ``within`` best. The ``backstop`` best of all are added (without a cluster), and a document
    that came twice stays once, with its cluster.
    """
    from .selection import mmr

    labelled = materialize(near.join(labels, "doc_id"), "labelled")
    mass = top_k(labelled, seeds).groupBy("query_id", "cluster").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("mass"))
    scored = centroids.join(mass, ["query_id", "cluster"]).withColumn("worth", F.round(0.7 * F.col("centroid_sim") + 0.3 * F.col("mass"), 9))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("worth"), "cluster"))).where(F.col("n") <= clusters)
    each = Window.partitionBy("query_id")
    positive, rest = F.sum(F.greatest("worth", F.lit(0.0))).over(each), F.lit(total) - F.count(F.lit(1)).over(each)
    share = F.greatest("worth", F.lit(0.0)) / positive
    budget = F.when((positive <= 0) | (rest <= 0), F.lit(1)).otherwise(F.greatest(F.lit(1), 1 + F.bround(share * rest)))
    budgets = materialize(best.select("query_id", "cluster", budget.cast("int").alias("budget")), "budgets")
    inside = labelled.join(budgets, ["query_id", "cluster"])
    place = F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy(F.desc("score"), "doc_id"))
    pool = inside.withColumn("n", place).where(F.col("n") <= within).withColumn("_group", F.concat_ws(":", "query_id", "cluster"))
    chosen = mmr(pool.join(vectors, "doc_id").select(F.col("_group").alias("query_id"), "doc_id", "score", "vec"), total, lam)
    routed = pool.join(chosen.withColumnRenamed("query_id", "_group"), ["_group", "doc_id"]).where(F.col("place") <= F.col("budget")).select("query_id", "doc_id", "score", "cluster")
    added = top_k(near, backstop).select("query_id", "doc_id", "score", F.lit(None).cast(routed.schema["cluster"].dataType).alias("cluster"))
    return best_per_key([routed, added], ["query_id", "doc_id"], "score")
