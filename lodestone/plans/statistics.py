"""Counts, robust statistics, bins, quotas and agreement."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scoring
from ..operators import cluster, retrieval as r, sampling, stats
from ..session import table
from .registry import query
from .retrieval import DENSE


@query("count_by_category", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def count_by_category(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("conditional_counts", "SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events")
def conditional_counts(spark, sf):
    return table(spark, sf, "events").agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "views"), ("click", "clicks"), ("purchase", "purchases"), ("error", "errors"))])


@query("document_frequency", "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS term FROM documents) GROUP BY term HAVING count(*) >= 5")
def document_frequency(spark, sf):
    return r.document_frequencies(r.tokens(table(spark, sf, "documents"), "doc_id", "text")).where("df >= 5")


@query("term_frequency", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS term FROM documents) GROUP BY 1, 2 HAVING count(*) >= 10")
def term_frequency(spark, sf):
    return r.term_frequencies(r.tokens(table(spark, sf, "documents"), "doc_id", "text")).where("tf >= 10").select("doc_id", "term", "tf")


@query("median_mad", "SELECT median(n_chars) AS median, round(1.4826 * mad(n_chars), 6) AS mad FROM documents")
def median_mad(spark, sf):
    return stats.median_mad(table(spark, sf, "documents"), "n_chars").select("median", F.round("mad", 6).alias("mad"))


@query(
    "median_mad_by_source",
    "WITH m AS (SELECT source, median(n_chars) AS median FROM documents GROUP BY 1) SELECT d.source, m.median, round(1.4826 * median(abs(n_chars - m.median)), 6) AS mad FROM documents d JOIN m ON d.source = m.source GROUP BY 1, 2",
)
def median_mad_by_source(spark, sf):
    return stats.median_mad(table(spark, sf, "documents"), "n_chars", ["source"]).select("source", "median", F.round("mad", 6).alias("mad"))


INTERVAL = "WITH m AS (SELECT median(n_chars) AS m FROM documents), s AS (SELECT m, 1.4826 * median(abs(n_chars - m)) AS mad FROM documents, m GROUP BY m)"


@query("interval_filter", f"{INTERVAL} SELECT doc_id, n_chars FROM documents, s WHERE n_chars BETWEEN m - 1.96 * mad AND m + 1.96 * mad")
def interval_filter(spark, sf):
    return stats.interval_filter(table(spark, sf, "documents"), "n_chars").select("doc_id", "n_chars")


@query("upper_outliers", f"{INTERVAL} SELECT doc_id, n_chars FROM documents, s WHERE n_chars > m + 3 * mad")
def upper_outliers(spark, sf):
    docs = table(spark, sf, "documents")
    median, mad = stats.median_mad_values(docs, "n_chars")
    return docs.where(F.col("n_chars") > F.lit(median) + 3 * F.lit(mad)).select("doc_id", "n_chars")


@query("percentile_threshold", "SELECT round(least(greatest(quantile_cont(l_discount, 0.85), 0.05), 0.99), 6) AS tau FROM lineitem")
def percentile_threshold(spark, sf):
    return stats.percentile_threshold(table(spark, sf, "lineitem"), "l_discount", low=0.05).select(F.round("tau", 6).alias("tau"))


@query(
    "quantile_bins",
    "WITH e AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM documents) SELECT doc_id, CAST(n_chars >= a AS INTEGER) + CAST(n_chars >= b AS INTEGER) + CAST(n_chars >= c AS INTEGER) AS bin FROM documents, e",
)
def quantile_bins(spark, sf):
    return stats.quantile_bins(table(spark, sf, "documents"), "n_chars", 4).select("doc_id", "bin")


@query(
    "median_side_chunks",
    "SELECT doc_id, side, ntile(4) OVER (PARTITION BY side ORDER BY n_chars, doc_id) AS chunk FROM (SELECT doc_id, n_chars, CASE WHEN n_chars <= (SELECT median(n_chars) FROM documents) THEN 'low' ELSE 'high' END AS side FROM documents)",
)
def median_side_chunks(spark, sf):
    return stats.median_sides(table(spark, sf, "documents"), "n_chars", "doc_id").select("doc_id", "side", "chunk")


@query(
    "median_bifurcation",
    "WITH m AS (SELECT median(l_quantity) AS a, median(l_extendedprice) AS b, median(l_discount) AS c FROM lineitem) SELECT l_quantity <= a AS q, l_extendedprice <= b AS p, l_discount <= c AS d, count(*) AS n FROM lineitem, m GROUP BY 1, 2, 3",
)
def median_bifurcation(spark, sf):
    """Median splits of three measures: two to the third cells."""
    li = table(spark, sf, "lineitem")
    m = li.agg(F.median("l_quantity").alias("a"), F.median("l_extendedprice").alias("b"), F.median("l_discount").alias("c"))
    return li.crossJoin(F.broadcast(m)).groupBy((F.col("l_quantity") <= F.col("a")).alias("q"), (F.col("l_extendedprice") <= F.col("b")).alias("p"), (F.col("l_discount") <= F.col("c")).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("group_shares", "SELECT source, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) WHERE n >= 2 QUALIFY n / CAST(sum(n) OVER () AS DOUBLE) >= 0.005")
def group_shares(spark, sf):
    """Frequency gate: at least two attestations and half a percent of all."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    s = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.withColumn("s", s).where("s >= 0.005").select("source", "n", F.round("s", 6).alias("share"))


@query("corroboration", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 3")
def corroboration(spark, sf):
    """Keys seen in three or more independent domains."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds")).where("kinds >= 3")


@query("softmax_class_weights", "WITH m AS (SELECT lang, avg(n_chars) AS mean_len FROM documents GROUP BY 1), e AS (SELECT *, exp(ln(1 / mean_len) / 0.5) AS e FROM m) SELECT lang, round(mean_len, 6) AS mean_len, round(e / sum(e) OVER (), 6) AS p FROM e")
def softmax_class_weights(spark, sf):
    return sampling.softmax_rates(table(spark, sf, "documents"), "lang", "n_chars", 0.5)


@query("rate_by_user", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1")
def rate_by_user(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@query(
    "log2_length_bins",
    "SELECT lang, CAST(floor(log2(greatest(n_chars, 1)) + 1e-12) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY 1, 2",
)
def log2_length_bins(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", scoring.length_bin(F.col("n_chars")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cell_quotas",
    """WITH c AS (SELECT lang || ':' || source AS cell, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT cell, n, greatest(CAST(floor(n / CAST(sum(n) OVER () AS DOUBLE) * 200) AS BIGINT), 1) AS q, n / CAST(sum(n) OVER () AS DOUBLE) * 200 - floor(n / CAST(sum(n) OVER () AS DOUBLE) * 200) AS rest FROM c)
SELECT cell, n, q + CASE WHEN row_number() OVER (ORDER BY rest DESC, cell) <= 200 - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM b""",
)
def cell_quotas(spark, sf):
    """Quotas of 200 over (language, source) cells, at least one each."""
    c = table(spark, sf, "documents").groupBy(F.concat_ws(":", "lang", "source").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder_quotas(c, "n", 200, "cell")


SAMPLE_U = "(CAST(CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"


@query("weighted_sample", f"SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY -ln({SAMPLE_U}) / n_chars, doc_id LIMIT 100")
def weighted_sample(spark, sf):
    """100 documents by weight without replacement (a sampling operator)."""
    return sampling.weighted_sample(table(spark, sf, "documents"), "doc_id", F.col("n_chars").cast("double"), 100).select("doc_id", "n_chars")


@query("stratified_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SAMPLE_U}, doc_id) AS k FROM documents) WHERE k <= 13")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents")
    quotas = docs.select("lang").distinct().withColumn("quota", F.lit(13))
    return sampling.stratified(docs, quotas, "lang", "doc_id").select("doc_id", "lang")


@query(
    "sample_idf_fidelity",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS tokens FROM documents),
s AS (SELECT doc_id FROM d ORDER BY -ln((CAST(CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0), doc_id LIMIT 500),
t AS (SELECT doc_id, unnest(tokens) AS term FROM d),
a AS (SELECT term, count(*) AS n_tokens, ln(((SELECT count(*) FROM d) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1) AS i1 FROM t GROUP BY 1),
b AS (SELECT term, ln(((SELECT count(*) FROM s) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1) AS i2 FROM t WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY 1)
SELECT round(sum(CASE WHEN i2 IS NOT NULL THEN n_tokens ELSE 0 END) / sum(n_tokens), 6) AS coverage, round(avg(abs(i1 - i2)), 6) AS idf_mae FROM a LEFT JOIN b ON a.term = b.term""",
)
def sample_idf_fidelity(spark, sf):
    """Token coverage and IDF error of a sample of 500 against the whole."""
    d = r.tokens(table(spark, sf, "documents"), "doc_id", "text")
    return sampling.idf_fidelity(d, sampling.even_sample(d, "doc_id", 500))


@query("anchor_pack", None)
def anchor_pack(spark, sf):
    """Documents packed to a budget of 20,000 characters, longest first, per source."""
    return sampling.anchor_pack(table(spark, sf, "documents"), "doc_id", "n_chars", 20_000, "source")


@query("cdf_steps", "SELECT lang, round(cdf, 6) AS cdf, round(cdf - lag(cdf, 1, 0.0) OVER (ORDER BY m, lang), 6) AS step FROM (SELECT lang, m, cume_dist() OVER (ORDER BY m) AS cdf FROM (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY 1))")
def cdf_steps(spark, sf):
    m = table(spark, sf, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"))
    out = stats.cdf_steps(m, F.cume_dist().over(Window.orderBy("m")), "m", "lang")
    return out.select("lang", F.round("cdf", 6).alias("cdf"), F.round("step", 6).alias("step"))


@query("label_entropy", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT source, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS p FROM n) SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def label_entropy(spark, sf):
    return cluster.entropy(table(spark, sf, "documents"), "source", "lang")


@query(
    "label_divergence",
    "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT source, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS p, sum(n) OVER (PARTITION BY lang) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM n) SELECT source, round(sum(p * ln(p / q)), 6) AS kl FROM p GROUP BY 1",
)
def label_divergence(spark, sf):
    return cluster.divergence(table(spark, sf, "documents"), "source", "lang")


CONT = "t AS (SELECT o_orderstatus AS la, o_orderpriority AS lb, count(*) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT la, sum(n) AS n FROM t GROUP BY 1), cb AS (SELECT lb, sum(n) AS n FROM t GROUP BY 1)"


@query(
    "adjusted_rand",
    f"WITH {CONT}, x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS cells, (SELECT sum(n * (n - 1) / 2.0) FROM ra) AS r, (SELECT sum(n * (n - 1) / 2.0) FROM cb) AS c, (SELECT sum(n) FROM t) AS total) SELECT round((cells - r * c / (total * (total - 1) / 2.0)) / ((r + c) / 2 - r * c / (total * (total - 1) / 2.0)), 6) AS ari FROM x",
)
def adjusted_rand(spark, sf):
    return cluster.adjusted_rand(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "nmi",
    f"WITH {CONT}, j AS (SELECT t.n, ra.n AS na, cb.n AS nb, (SELECT sum(n) FROM t) AS total FROM t JOIN ra ON t.la = ra.la JOIN cb ON t.lb = cb.lb), x AS (SELECT (SELECT sum(n / total * ln(n * total / (CAST(na AS DOUBLE) * nb))) FROM j) AS mi, (SELECT -sum(n / (SELECT sum(n) FROM t) * ln(n / (SELECT sum(n) FROM t))) FROM ra) AS ha, (SELECT -sum(n / (SELECT sum(n) FROM t) * ln(n / (SELECT sum(n) FROM t))) FROM cb) AS hb) SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM x",
)
def nmi(spark, sf):
    return cluster.normalized_mutual_information(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


COORD = "x AS (SELECT vec_id, label, unnest(range(1, 65)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), c AS (SELECT label, dim, avg(x) AS c FROM x GROUP BY 1, 2)"


@query("centroids", f"WITH {COORD} SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY label)), 6) AS c FROM c")
def centroids(spark, sf):
    return cluster.centroids(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").withColumn("c", F.round("c", 6))


@query("intra_distances", f"WITH {COORD} SELECT vec_id AS id, x.label, round(sqrt(sum((x - c) * (x - c))), 6) AS distance FROM x JOIN c ON x.label = c.label AND x.dim = c.dim GROUP BY 1, 2")
def intra_distances(spark, sf):
    return cluster.intra_distances(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query("bss_tss", f"WITH {COORD}, g AS (SELECT dim, avg(x) AS g FROM x GROUP BY 1) SELECT round((sum((x - g) * (x - g)) - sum((x - c) * (x - c))) / sum((x - g) * (x - g)), 6) AS bss_tss FROM x JOIN c ON x.label = c.label AND x.dim = c.dim JOIN g ON x.dim = g.dim")
def bss_tss(spark, sf):
    return cluster.bss_tss(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def _tfidf_vectors(spark, sf):
    q = r.tokens(table(spark, sf, "benchmark"), "item_id", "text")
    return cluster.hashed_vectors(r.tfidf(q), "doc_id", "term", "weight")


@query("kmeans_tfidf", None)
def kmeans_tfidf(spark, sf):
    """Five clusters of the benchmark items by their TF-IDF vectors, the best of three starts."""
    return cluster.kmeans_restarts(_tfidf_vectors(spark, sf), "doc_id", "vec", 5)


@query("gaussian_mixture", None)
def gaussian_mixture(spark, sf):
    """Soft clusters of the embeddings' first eight coordinates."""
    v = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("head"))
    return cluster.gaussian_mixture(v, "vec_id", "head", 4).withColumn("confidence", F.round("confidence", 6))


@query("explained_variance", None)
def explained_variance(spark, sf):
    """Share of the TF-IDF view's variance in its 16 leading directions."""
    return cluster.explained_variance(_tfidf_vectors(spark, sf), "vec", 16)


@query("composite_cluster_score", f"WITH {COORD}, gm AS (SELECT dim, avg(x) AS g FROM x GROUP BY 1), bt AS (SELECT round((sum((x - g) * (x - g)) - sum((x - c) * (x - c))) / sum((x - g) * (x - g)), 6) AS bss FROM x JOIN c ON x.label = c.label AND x.dim = c.dim JOIN gm ON x.dim = gm.dim), {DENSE.strip()}, d AS (SELECT query_id AS u, label AS lv, avg(1 - score) AS d FROM two JOIN embeddings ON doc_id = vec_id GROUP BY 1, 2), y AS (SELECT u, max(CASE WHEN lv = e.label THEN d END) AS a, min(CASE WHEN lv <> e.label THEN d END) AS b FROM d JOIN embeddings e ON u = vec_id GROUP BY 1), sl AS (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS s FROM y) SELECT round(0.5 * (s + 1) / 2 + 0.5 * bss, 6) AS score FROM sl, bt")
def composite_cluster_score(spark, sf):
    """Silhouette and between-cluster share of the labels in one figure."""
    v = table(spark, sf, "embeddings")
    from .selections import _label_means

    return cluster.composite_score(cluster.silhouette(_label_means(v), v.select(F.col("vec_id").alias("id"), "label")), cluster.bss_tss(v, "vec_id", "embedding", "label"))


@query("kmeans_labels", None)
def kmeans_labels(spark, sf):
    return cluster.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query("kmeans_elbow", None)
def kmeans_elbow(spark, sf):
    return cluster.elbow(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("min_max_scaled", "WITH m AS (SELECT min(n_chars) AS a, max(n_chars) AS b FROM documents WHERE lang = 'en') SELECT doc_id, round((n_chars - a) / CAST(b - a AS DOUBLE), 6) AS scaled FROM documents, m")
def min_max_scaled(spark, sf):
    """Scaling fitted on one part (English), applied unclipped to all."""
    d = table(spark, sf, "documents")
    m = d.where("lang = 'en'").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"))
    return d.crossJoin(F.broadcast(m)).select("doc_id", F.round((F.col("n_chars") - F.col("a")) / (F.col("b") - F.col("a")), 6).alias("scaled"))  # one row


@query("regression_slope", "SELECT lang, round(regr_slope(toxic, n_chars), 9) AS slope FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def regression_slope(spark, sf):
    """Linear effect of length on the label, by language."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").groupBy("lang").agg(F.round(F.regr_slope("toxic", "n_chars"), 9).alias("slope"))


@query("signature_keys", "WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT count(DISTINCT user_id) AS m FROM events) SELECT event_type, count(*) AS users FROM k, u WHERE n >= 3 GROUP BY event_type, m HAVING count(*) >= 0.6 * m")
def signature_keys(spark, sf):
    """Types that at least 60 % of users have three times or more."""
    e = table(spark, sf, "events")
    k = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
    return k.crossJoin(F.broadcast(e.agg(F.countDistinct("user_id").alias("m")))).where("users >= 0.6 * m").select("event_type", "users")  # one row
