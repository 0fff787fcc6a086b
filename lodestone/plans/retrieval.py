"""Sparse, dense and hybrid retrieval over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..operators import evalmetrics, retrieval as r, sampling, similarity as sim, sparse, strips
from ..session import materialize, table
from .registry import query

TOKENS = """
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS tokens FROM documents),
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '\\p{L}+') AS tokens FROM benchmark),
"""
SAMPLE = "-ln((CAST(CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"
BM25 = TOKENS + """
st AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM d),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY 1, 2),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM d) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT doc_id, tf.term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al)) AS part FROM tf JOIN df ON tf.term = df.term CROSS JOIN st),
bm AS (SELECT query_id, doc_id, round(sum(part * qtf), 6) AS score FROM part JOIN qt ON part.term = qt.term GROUP BY 1, 2)
"""


def _docs(spark, sf) -> DataFrame:
    return r.tokens(table(spark, sf, "documents"), "doc_id", "text")


def _queries(spark, sf) -> DataFrame:
    return r.tokens(table(spark, sf, "benchmark"), "item_id", "text", "query_id")


@query("bm25_top5", f"WITH {BM25} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def bm25_top5(spark, sf):
    return sparse.bm25_best(_docs(spark, sf), _queries(spark, sf), 5)


@query(
    "bm25_proxy_top10",
    f"""WITH {TOKENS}
p AS (SELECT * FROM d ORDER BY {SAMPLE}, doc_id LIMIT 500),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM p),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY 1, 2),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM d) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf WHERE doc_id IN (SELECT doc_id FROM p) GROUP BY 1),
part AS (SELECT doc_id, tf.term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al)) AS part FROM tf JOIN df ON tf.term = df.term CROSS JOIN st),
bm AS (SELECT query_id, doc_id, round(sum(part * qtf), 6) AS score FROM part JOIN qt ON part.term = qt.term GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10""",
)
def bm25_proxy_top10(spark, sf):
    """BM25 of all documents with the statistics of a sample pool of 500 (the operator's feature; every document is scored)."""
    docs = _docs(spark, sf)
    return sparse.bm25_best(docs, _queries(spark, sf), 10, pool=sampling.even_sample(docs, "doc_id", 500))


TFIDF = """
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS tokens FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 8000),
raw AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1) AS raw FROM tf JOIN v ON tf.term = v.term),
w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


@query("tfidf_norms", f"WITH {TFIDF} SELECT doc_id, count(*) AS n_terms, round(max(weight), 6) AS top_weight, round(sum(weight), 5) AS mass FROM w GROUP BY doc_id")
def tfidf_norms(spark, sf):
    """TF-IDF vectors of 8,000 features, summed up per document."""
    return r.tfidf(_docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 5).alias("mass"))


@query(
    "expanded_bm25_top10",
    f"""WITH {BM25}, e AS (SELECT query_id, doc_id, round(sum(round(part, 6)), 6) AS score FROM part JOIN (SELECT DISTINCT query_id, term FROM qt) x ON part.term = x.term GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM e WHERE score > 0) WHERE rank <= 10""",
)
def expanded_bm25_top10(spark, sf):
    """Every distinct term of an item is an expansion of its own: their scores add up."""
    return sparse.bm25_best(_docs(spark, sf), _queries(spark, sf), 10, expansions=True)


DENSE = """
p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
two AS (SELECT a AS query_id, b AS doc_id, score FROM p UNION ALL SELECT b, a, score FROM p)
"""


@query("dense_top50", f"WITH {DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM two) WHERE rank <= 50")
def dense_top50(spark, sf):
    return sim.dense_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 50)


@query("cosine_pair_stats", f"WITH {DENSE} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM p")
def cosine_pair_stats(spark, sf):
    """Mean and population deviation of the cosines of all pairs."""
    c = materialize(strips.score_counts(strips.vectors_of(table(spark, sf, "embeddings"), "vec_id", "embedding")), "scores")
    mean = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("m"))
    gap = F.col("score") - F.col("m")
    sd = c.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.sum(gap * gap * F.col("n")) / F.sum("n")).alias("sd"))  # one row
    return mean.crossJoin(F.broadcast(sd)).select(F.col("all").alias("n"), F.round("m", 6).alias("mean"), F.round("sd", 6).alias("sd"))  # one row each


SELF = """
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS tokens FROM documents),
q AS (SELECT doc_id AS query_id, tokens FROM d WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
"""
HYBRID = BM25.replace(TOKENS, SELF) + ", " + DENSE.strip() + """,
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE query_id <> doc_id),
v AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM two WHERE query_id IN (SELECT query_id FROM q))
"""


def _hybrid(spark, sf, dense: int, lexical: int) -> tuple[DataFrame, DataFrame]:
    """Dense and BM25 rankings for every twentieth document that has a vector; a document doesn't find itself."""
    docs, v = _docs(spark, sf), table(spark, sf, "embeddings")
    ids = v.select(F.col("vec_id").alias("query_id"))
    q = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id").join(ids, "query_id", "left_semi")
    near = sim.dense_neighbours(v, "vec_id", "embedding", dense, v.join(q.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"))
    return near, sparse.bm25_best(docs, q, lexical, apart=True)


@query(
    "rrf_hybrid_top10",
    f"""WITH {HYBRID},
f AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM v WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM l WHERE rank <= 10),
g AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM f GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
)
def rrf_hybrid_top10(spark, sf):
    """Two rankings of different depth (dense 50, BM25 10) fused by reciprocal ranks."""
    near, lexical = _hybrid(spark, sf, 50, 10)
    return r.top_k(r.reciprocal_rank_fusion([near, lexical]), 10)


@query(
    "cascade_top10",
    f"""WITH {HYBRID},
f AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM v WHERE rank <= 169 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM l WHERE rank <= 169),
s0 AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM f GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s0) WHERE rank <= 144),
k AS (SELECT query_id AS doc_id, doc_id AS other, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM two) WHERE rank <= 5),
x0 AS (SELECT query_id, other AS doc_id, round(sum(s.score * k.score), 9) AS score FROM s JOIN k ON s.doc_id = k.doc_id GROUP BY 1, 2),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x0) WHERE rank <= 144),
pool AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM s UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM x) GROUP BY 1, 2),
u AS (SELECT DISTINCT query_id, doc_id // 10 AS unit FROM pool WHERE doc_id IN (SELECT doc_id FROM documents)),
e AS (SELECT query_id, doc_id // 10 AS unit, max(score) AS late FROM two WHERE query_id IN (SELECT query_id FROM q) GROUP BY 1, 2),
z AS (SELECT u.query_id, u.unit AS doc_id, late AS score FROM u JOIN e ON u.query_id = e.query_id AND u.unit = e.unit)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 10""",
)
def cascade_top10(spark, sf):
    """The layered retrieval: chunks are documents, units ten of them, the late interaction is the greatest cosine in a unit."""
    near, lexical = _hybrid(spark, sf, 169, 169)
    v = table(spark, sf, "embeddings")
    links = sim.dense_neighbours(v, "vec_id", "embedding", 5).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("other"), "score")
    unit = F.floor(F.col("doc_id") / 10).cast("long")
    units = table(spark, sf, "documents").select("doc_id", unit.alias("unit"))

    def late(wanted):
        return strips.group_best(v.withColumn("unit", F.floor(F.col("vec_id") / 10).cast("long")), "vec_id", "embedding", "unit", wanted)

    return r.cascade(lexical, near, links, units, late)


@query("affinity_rows", f"WITH {DENSE}, e AS (SELECT query_id AS id, doc_id AS other, score FROM two UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings) SELECT id, list(score ORDER BY other) AS affinity FROM e WHERE id % 10 = 0 AND other % 10 = 0 GROUP BY id")
def affinity_rows(spark, sf):
    """The affinity space of every tenth vector (the operator's matrix is square, so it is meant for a sample)."""
    v = table(spark, sf, "embeddings").where("vec_id % 10 = 0")
    return r.affinity_rows(sim.dense_pairs(v, "vec_id", "embedding"), v.select(F.col("vec_id").alias("id")))


@query("match_or_new", f"WITH {DENSE}, m AS (SELECT query_id AS id, doc_id AS other, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM two WHERE query_id % 2 = 1 AND doc_id % 2 = 0 AND score >= 0.35) SELECT vec_id AS id, other AS match, score, other IS NULL AS is_new FROM embeddings LEFT JOIN m ON vec_id = m.id AND n = 1 WHERE vec_id % 2 = 1")
def match_or_new(spark, sf):
    """Odd vectors matched with the collection of even ones, or new."""
    v = table(spark, sf, "embeddings")
    p = sim.dense_pairs(v, "vec_id", "embedding", above=0.34)
    two = p.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(p.select("b", "a", "score"))
    odd, even = (v.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias("id")) for k in (1, 0))
    return r.match_or_new(odd, even, two, 0.35)


@query(
    "retrieval_systems",
    f"""WITH {DENSE},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM two),
l AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) - 1 AS total FROM embeddings),
h AS (SELECT query_id, count(*) AS hits FROM k JOIN l a ON k.doc_id = a.vec_id JOIN l b ON k.query_id = b.vec_id WHERE rank <= 10 AND a.label = b.label GROUP BY 1)
SELECT vec_id AS query_id, round(coalesce(hits, 0) / 10.0, 6) AS precision, round(CASE WHEN total > 0 THEN coalesce(hits, 0) / CAST(least(total, 10) AS DOUBLE) ELSE 0.0 END, 6) AS recall FROM l LEFT JOIN h ON vec_id = query_id""",
)
def retrieval_systems(spark, sf):
    """Context precision and recall at 10 of dense retrieval; relevant means the same label."""
    v = table(spark, sf, "embeddings")
    return evalmetrics.category_precision_recall(sim.dense_neighbours(v, "vec_id", "embedding", 10), v.select(F.col("vec_id").alias("id"), "label"))


@query(
    "token_jaccard_top5",
    f"""WITH {TOKENS}
qs AS (SELECT query_id, unnest(list_distinct(tokens)) AS t FROM q), ds AS (SELECT doc_id, unnest(list_distinct(tokens)) AS t FROM d),
qn AS (SELECT query_id, count(*) AS n FROM qs GROUP BY 1), dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
o AS (SELECT query_id, doc_id, count(*) AS overlap FROM qs JOIN ds ON qs.t = ds.t GROUP BY 1, 2),
s AS (SELECT o.query_id, o.doc_id, round(overlap / CAST(qn.n + dn.n - overlap AS DOUBLE), 6) AS score FROM o JOIN qn ON o.query_id = qn.query_id JOIN dn ON o.doc_id = dn.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def token_jaccard_top5(spark, sf):
    """Set Jaccard of benchmark items and documents through shared tokens."""
    q = _queries(spark, sf).select("query_id", F.explode(F.array_distinct("tokens")).alias("t"))
    d = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct("tokens")).alias("t"))
    o = q.join(d, "t").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("overlap"))
    s = o.join(q.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq")), "query_id").join(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nd")), "doc_id")
    return r.top_k(s.select("query_id", "doc_id", F.round(F.col("overlap") / (F.col("nq") + F.col("nd") - F.col("overlap")), 6).alias("score")), 5)


@query(
    "item_jaccard",
    f"""WITH {TOKENS}
f AS (SELECT query_id AS k, unnest(list_distinct(tokens)) AS f FROM q), n AS (SELECT k, count(*) AS n FROM f GROUP BY 1),
o AS (SELECT x.k AS a, y.k AS b, count(*) AS overlap FROM f x JOIN f y ON x.f = y.f AND x.k < y.k GROUP BY 1, 2)
SELECT a, b, overlap, na.n + nb.n - overlap AS "union", round(overlap / CAST(na.n + nb.n - overlap AS DOUBLE), 6) AS score FROM o JOIN n na ON a = na.k JOIN n nb ON b = nb.k""",
)
def item_jaccard(spark, sf):
    """All-pairs set Jaccard of the benchmark items through the inverted index."""
    f = _queries(spark, sf).select("query_id", F.explode("tokens").alias("f"))
    return sim.set_jaccard(f, "query_id", "f").withColumn("score", F.round("score", 6))


@query(
    "jaccard_pairs",
    """WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS f FROM documents), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap FROM f x JOIN f y ON x.f = y.f AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT * FROM (SELECT a, b, overlap, round(overlap / CAST(x.n + y.n - overlap AS DOUBLE), 6) AS score FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id) WHERE score >= 0.8""",
)
def jaccard_pairs(spark, sf):
    """Pairs of documents whose token sets have a Jaccard of 0.8 or more, by their rarest tokens."""
    return sim.jaccard_at_least(_docs(spark, sf).select("doc_id", F.explode("tokens").alias("f")), "doc_id", "f", 0.8)


@query(
    "dual_jaccard",
    f"""WITH {TOKENS}
t AS (SELECT query_id AS k, unnest(list_distinct(tokens)) AS f FROM q), tn AS (SELECT k, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT item_id AS k, string_split(lower(text), '') AS c FROM benchmark),
g AS (SELECT DISTINCT k, g AS f FROM (SELECT k, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM c) WHERE regexp_full_match(replace(g, ' ', ''), '\\p{{L}}+')), gn AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
s1 AS (SELECT a, b, o / CAST(x.n + y.n - o AS DOUBLE) AS s FROM (SELECT x.k AS a, y.k AS b, count(*) AS o FROM t x JOIN t y ON x.f = y.f AND x.k < y.k GROUP BY 1, 2) JOIN tn x ON a = x.k JOIN tn y ON b = y.k),
s2 AS (SELECT a, b, o / CAST(x.n + y.n - o AS DOUBLE) AS s FROM (SELECT x.k AS a, y.k AS b, count(*) AS o FROM g x JOIN g y ON x.f = y.f AND x.k < y.k GROUP BY 1, 2) JOIN gn x ON a = x.k JOIN gn y ON b = y.k)
SELECT a, b, score FROM (SELECT coalesce(s1.a, s2.a) AS a, coalesce(s1.b, s2.b) AS b, round((coalesce(s1.s, 0) + coalesce(s2.s, 0)) / 2, 6) AS score FROM s1 FULL JOIN s2 ON s1.a = s2.a AND s1.b = s2.b) WHERE score > 0.05""",
)
def dual_jaccard(spark, sf):
    """Edges of the benchmark items by the mean of token and character-trigram Jaccard, above 0.05."""
    t = _queries(spark, sf).select("query_id", F.explode("tokens").alias("f"))
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.filter(F.split(F.lower("text"), ""), lambda x: x != "").alias("c")).where("size(c) >= 3")
    at = lambda i: F.slice("c", F.lit(i), F.size("c") - 2)
    both = lambda x, y: F.concat(x, y)
    g = c.select("query_id", F.explode(F.zip_with(F.zip_with(at(1), at(2), both), at(3), both)).alias("f")).where(F.replace("f", F.lit(" "), F.lit("")).rlike(r"^\p{L}+$"))
    return sim.dual_jaccard(t, g, "query_id", "f", "f")


@query(
    "fused_similarity",
    f"""WITH {DENSE} SELECT a, b, sparse, score AS dense, round(0.7 * sparse + 0.3 * score, 8) AS fused, CASE WHEN 0.7 * sparse + 0.3 * score >= 0.8 THEN 'MERGE' WHEN 0.7 * sparse + 0.3 * score >= 0.5 THEN 'migrate' WHEN 0.7 * sparse + 0.3 * score >= 0.3 THEN 'xref' ELSE 'low' END AS action
FROM (SELECT p.a, p.b, p.score, CAST(CAST(x.label = y.label AS INTEGER) AS DOUBLE) AS sparse FROM p JOIN embeddings x ON p.a = x.vec_id JOIN embeddings y ON p.b = y.vec_id) """,
)
def fused_similarity(spark, sf):
    """Sparse (label set) and dense (cosine) scores fused 0.7 / 0.3, with the prescribed action."""
    v = table(spark, sf, "embeddings")
    p = strips.pairs(strips.vectors_of(v, "vec_id", "embedding", F.col("label")), carry=True)
    j = p.withColumn("sparse", (F.col("xa") == F.col("xb")).cast("double"))
    fused = sim.fuse(F.col("sparse"), F.col("score"), F.lit(True))
    return j.select("a", "b", "sparse", F.col("score").alias("dense"), F.round(fused, 8).alias("fused"), scoring.prescription(fused).alias("action"))


@query("retrieval_index", "SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS term FROM documents) GROUP BY term")
def retrieval_index(spark, sf):
    """The inverted index, summed up per term."""
    d = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(
    "lang_mrr",
    f"""WITH {BM25},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
top AS (SELECT query_id, doc_id AS want FROM k WHERE rank = 2),
f AS (SELECT t.query_id, min(k.rank) AS first FROM top t LEFT JOIN k ON k.query_id = t.query_id AND k.doc_id = t.want AND k.rank <= 3 GROUP BY 1)
SELECT round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f""",
)
def lang_mrr(spark, sf):
    """MRR@3 of BM25 where the wanted document of each item is its second best."""
    k = materialize(sparse.bm25_best(_docs(spark, sf), _queries(spark, sf), 3), "top")
    return evalmetrics.mrr(k, k.where("rank = 2").select("query_id", "doc_id"))


@query(
    "bm25_rank_fit",
    f"""WITH {BM25},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
w AS (SELECT query_id, min(doc_id) AS want FROM k WHERE rank <= 12 GROUP BY 1),
f AS (SELECT w.query_id, min(k.rank) AS r FROM w LEFT JOIN k ON k.query_id = w.query_id AND k.doc_id = w.want AND k.rank <= 8 GROUP BY 1)
SELECT query_id, round(coalesce(1.0 / r, 0.0), 6) AS precision, CAST(r IS NOT NULL AS DOUBLE) AS recall, round((coalesce(1.0 / r, 0.0) + CAST(r IS NOT NULL AS DOUBLE)) / 2, 6) AS fit FROM f""",
)
def bm25_rank_fit(spark, sf):
    """Rank-sensitive precision, recall and fit at 8."""
    k = materialize(sparse.bm25_best(_docs(spark, sf), _queries(spark, sf), 12), "top")
    want = k.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return evalmetrics.rank_fit(k, want)


@query(
    "blended_ranking",
    f"""WITH {DENSE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM two),
t AS (SELECT * FROM k WHERE rank <= 20)
SELECT query_id, doc_id, rank, round(0.7 * score + 0.3 * (1.0 - 0.9 * (rank - 1) / 19.0), 9) AS blended, round(0.6 * abs(score) + 0.3 * (1 - CAST(a.label = b.label AS INTEGER)) + 0.1 / (1 + abs(score)), 6) AS distance
FROM t JOIN embeddings a ON t.query_id = a.vec_id JOIN embeddings b ON t.doc_id = b.vec_id""",
)
def blended_ranking(spark, sf):
    """Similarity blended with rank relevance, and the composite distance."""
    v = table(spark, sf, "embeddings")
    k = sim.dense_neighbours(v, "vec_id", "embedding", 20)
    lab = lambda n, c: v.select(F.col("vec_id").alias(n), F.col("label").alias(c))
    j = k.join(lab("query_id", "lq"), "query_id").join(lab("doc_id", "ld"), "doc_id")
    return j.select(
        "query_id", "doc_id", "rank",
        F.round(r.blended(F.col("score"), r.rank_relevance(F.col("rank"), F.lit(20)), 0.3), 9).alias("blended"),
        F.round(r.composite_distance(F.col("score"), F.col("lq") == F.col("ld"), 1 + F.abs("score")), 6).alias("distance"),
    )


@query(
    "cluster_budgets",
    f"""WITH {DENSE}, s AS (SELECT query_id, label, sum(greatest(score, 0)) AS mass FROM two JOIN embeddings ON doc_id = vec_id GROUP BY 1, 2)
SELECT query_id, label, round(mass, 6) AS mass, CAST(1 + round(mass / sum(mass) OVER (PARTITION BY query_id) * greatest(50 - count(*) OVER (PARTITION BY query_id), 0)) AS INTEGER) AS budget FROM s""",
)
def cluster_budgets(spark, sf):
    """Bag of seeds: positive cosine mass per cluster, and each cluster's share of a budget of 50."""
    v = table(spark, sf, "embeddings")
    every = strips.vectors_of(v, "vec_id", "embedding", F.col("label"))
    mass = strips.score_sums(every, every, above=0.0).select(F.col("id").alias("query_id"), "label", F.col("total").alias("mass"))
    return r.cluster_budget(mass, "label", "mass", 50).withColumn("mass", F.round("mass", 6))


@query("max_sim_spans", None)
def max_sim_spans(spark, sf):
    """Word spans of each conversation turn that come close to the turn before it: per word the greatest trigram
    Jaccard with a word there, threshold 0.5, neighbouring words merged."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    w = c.withColumn("before", F.array_distinct(F.split(F.lower(prev), r"\s+"))).where("before IS NOT NULL").select("conv_id", "turn", F.posexplode(r.max_sim_column(F.split(F.lower("text"), r"\s+"), F.col("before"))).alias("place", "sim"))
    near = w.where("sim >= 0.5")
    island = F.col("place") - F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("place"))
    return near.withColumn("i", island).groupBy("conv_id", "turn", "i").agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end")).drop("i")
