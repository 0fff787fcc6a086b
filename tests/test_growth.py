"""What is shuffled and written by the queries on all pairs of vectors grows with the vectors, not with the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.operators import retrieval, similarity, sparse, strips


def records(spark, run) -> int:
    """Records that the stages of ``run`` shuffle and write."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def stages() -> dict[tuple[int, int], int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        each = [found.apply(i) for i in range(found.size())]
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in each}

    before = set(stages())
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    """Folders with 1,200 and with 4,800 vectors of ten labels; both have some 30 edges a vector or more."""
    out = []
    for n in (1200, 4800):
        at = str(tmp_path_factory.mktemp(f"v{n}"))
        m = np.random.default_rng(7).normal(size=(n, 16)).astype("float32")
        spark.createDataFrame([(i, m[i].tolist(), i % 10) for i in range(n)], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{at}/embeddings.parquet")
        out.append(at)
    return out


LINEAR = [
    "dense_top50", "mmr_selection", "mmr_walk", "community_rerank", "retrieval_systems", "graph_degrees", "edge_dwpc", "cohesion", "modularity", "community_metrics",
    "cosine_graph", "hop_expansion", "graph_components", "silhouette", "composite_cluster_score", "cluster_budgets", "cluster_routing", "singleton_homes",
]


@pytest.mark.parametrize("name", LINEAR)
def test_records(spark, sizes, name):
    small, large = (records(spark, lambda at=at: plans.QUERIES[name](spark, at).agg(F.count(F.lit(1))).collect()) for at in sizes)
    assert large <= 5 * small, (small, large)


def test_folds(spark):
    """Odd vectors: a null, a zero one, equal ones; ties by id; labels that are null."""
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], None), (4, None, 2), (5, [0.0, -3.0], 2), (6, [1.0, 1.0], None)]
    v = strips.vectors_of(spark.createDataFrame(rows, "id long, v array<double>, g int"), "id", "v", F.col("g"))
    near = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in strips.nearest(v, 3).collect()}
    assert near[1, 1] == (2, 1.0) and near[1, 2] == (6, 0.707107) and near[1, 3] == (3, 0.0) and near[3, 1] == (1, 0.0) and near[5, 3] == (3, 0.0) and len(near) == 18
    sums = {(r["id"], r["label"]): tuple(r)[2:] for r in strips.score_sums(v, v, 0.5).collect()}
    assert sums[1, 1] == (1, 1, 1.0) and sums[1, None] == (2, 1, 0.707107) and sums[6, 1] == (2, 2, 1.414214) and sums[6, None] == (1, 0, 0.0)
    assert {tuple(r) for r in strips.pairs(v, 0.5).collect()} == {(1, 2, 1.0), (1, 6, 0.707107), (2, 6, 0.707107)}
    assert sum(r["n"] for r in strips.score_counts(v).collect()) == 15
    with pytest.raises(Exception, match="different lengths"):
        strips.pairs(strips.vectors_of(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v")).collect()


def test_affinity_keeps_signs(spark):
    """As in SQL, a cosine that rounds to nothing from below is -0.0 (arrays are compared bit by bit); missing pairs are 0."""
    d = spark.createDataFrame([(0, [1.0, 0.0]), (10, [-1e-8, 1.0]), (20, [1.0, 0.0])], "vec_id long, v array<double>")
    rows = retrieval.affinity_rows(similarity.dense_pairs(d, "vec_id", "v"), d.select(F.col("vec_id").alias("id"))).collect()
    assert {r["id"]: [str(x) for x in r["affinity"]] for r in rows} == {0: ["1.0", "-0.0", "1.0"], 10: ["-0.0", "1.0", "-0.0"], 20: ["1.0", "-0.0", "1.0"]}
    few = retrieval.affinity_rows(spark.createDataFrame([(0, 10, 0.5)], "a long, b long, score double"), d.select(F.col("vec_id").alias("id"))).collect()
    assert {r["id"]: r["affinity"] for r in few} == {0: [1.0, 0.5, 0.0], 10: [0.5, 1.0, 0.0], 20: [0.0, 0.0, 1.0]}


@pytest.mark.parametrize("name", ["rrf_hybrid_top10", "cascade_top10"])
def test_hybrid_records(spark, tmp_path, name):
    """Queries grow with the documents, yet a (query, document) pair is never a row."""
    counts = []
    for n in (600, 2400):
        g = np.random.default_rng(3)
        words = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)])
        spark.createDataFrame([(i, " ".join(g.choice(words, 30))) for i in range(n)], "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame([(i, g.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        counts.append(records(spark, lambda n=n: plans.QUERIES[name](spark, f"{tmp_path}/{n}").agg(F.count(F.lit(1))).collect()))
    assert counts[1] <= 8 * counts[0], counts  # four times the rows; their pairs are sixteen times as many


def test_bm25_best(spark):
    """As ``bm25`` and a ranking; null and empty texts; a pool; expansions."""
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["c", "b", "d"]), (6, ["a", "b", "a"])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["a", "b", "b"]), (5, ["c", "zz"]), (9, []), (8, ["zz"])], "query_id long, tokens array<string>")
    full = d.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    pool = full.where("doc_id IN (2, 5, 6)")
    rows = lambda t: {tuple(r) for r in t.select("query_id", "doc_id", "score", "rank").collect()}
    assert rows(sparse.bm25_best(d, q, 3)) == rows(retrieval.top_k(retrieval.bm25(full, q), 3)) != set()
    assert rows(sparse.bm25_best(full, q, 2, pool=pool)) == rows(retrieval.top_k(retrieval.bm25(full, q, pool=pool), 2))
    assert rows(sparse.bm25_best(full, q, 2, apart=True)) == rows(retrieval.top_k(retrieval.bm25(full, q).where("query_id <> doc_id"), 2))
    each = q.select("query_id", F.explode(F.array_distinct("tokens")).alias("t")).select("query_id", F.array("t").alias("tokens"))
    assert rows(sparse.bm25_best(full, q, 3, expansions=True)) == rows(retrieval.top_k(retrieval.expanded_bm25(full, each), 3))


def test_softmin(spark, sizes):
    """Weights of all others by the exact median distance, odd and even in number; records grow with the vectors."""
    for n in (6, 7):
        m = np.random.default_rng(n).normal(size=(n, 4))
        m[1] = m[0]
        d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        gap = 1 - np.round(u @ u.T, 6)
        t = [np.median(np.delete(gap[i], i)) for i in range(n)]
        got = {(r["query_id"], r["doc_id"]): r["weight"] for r in strips.softmin(d, "id", "v").collect()}
        assert got == {(i, j): pytest.approx(np.exp(-gap[i, j] / t[i]), abs=2e-6) for i in range(n) for j in range(n) if i != j}
    small, large = (records(spark, lambda at=at: plans.QUERIES["softmin_weights"](spark, at).agg(F.count(F.lit(1))).collect()) for at in sizes)
    assert large <= 5 * small, (small, large)
