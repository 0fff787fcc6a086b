"""Joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import retrieval, stores
from ..session import table
from .registry import query


@query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def inner_join(spark, sf):
    """Typed single hop."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("two_hop_semi", "SELECT DISTINCT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))")
def two_hop_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_name").distinct()


@query("bridge_join", "SELECT p_name, s_name, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def bridge_join(spark, sf):
    """Many to many over a bridge table."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_name", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_default", "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_default(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("snapshot_diff", "SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'modified' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents) a FULL JOIN (SELECT doc_id + 10 AS doc_id, md5(text) AS h FROM documents) b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    """Old and new state of all documents, the new one moved by ten ids."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return stores.snapshot_diff(d, d.withColumn("doc_id", F.col("doc_id") + 10), "doc_id", "h")


@query(
    "three_way_sync",
    """WITH b AS (SELECT p_partkey AS k, p_name AS h FROM part), m AS (SELECT p_partkey AS k, CASE WHEN p_size <= 10 THEN p_name || '1' ELSE p_name END AS h FROM part), r AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN p_name || '2' ELSE p_name END AS h FROM part)
SELECT b.k, CASE WHEN m.h = r.h THEN 'noop' WHEN r.h = b.h THEN 'ff-mirror' WHEN m.h = b.h THEN 'ff-master' ELSE 'conflict' END AS sync_case FROM b JOIN m ON b.k = m.k JOIN r ON b.k = r.k""",
)
def three_way_sync(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    b = p.select("k", F.col("p_name").alias("h"))
    m = p.select("k", F.when(F.col("p_size") <= 10, F.concat("p_name", F.lit("1"))).otherwise(F.col("p_name")).alias("h"))
    r = p.select("k", F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("2"))).otherwise(F.col("p_name")).alias("h"))
    return stores.three_way(b, m, r, "k", "h")


@query("set_differences", "SELECT o_custkey AS k, 'orders only' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'customers only' FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def set_differences(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return o.subtract(c).withColumn("side", F.lit("orders only")).union(c.subtract(o).withColumn("side", F.lit("customers only")))


@query("vocabulary_intersection", "SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM benchmark) WHERE term IN (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) FROM documents)")
def vocabulary_intersection(spark, sf):
    b = retrieval.tokens(table(spark, sf, "benchmark"), "item_id", "text").select(F.explode("tokens").alias("term")).distinct()
    d = retrieval.tokens(table(spark, sf, "documents"), "doc_id", "text").select(F.explode("tokens").alias("term"))
    return b.join(d, "term", "left_semi")


@query("n_way_intersection", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def n_way_intersection(spark, sf):
    """Keys that are in all of N sets."""
    o = table(spark, sf, "orders")
    n = o.agg(F.countDistinct("o_orderstatus").alias("n"))
    return o.groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("m")).crossJoin(F.broadcast(n)).where("m = n").select("o_custkey")  # one row


@query("best_of_union", "SELECT l_partkey, max(s) AS score FROM (SELECT l_partkey, l_discount AS s FROM lineitem UNION ALL SELECT l_partkey, l_tax FROM lineitem) GROUP BY 1")
def best_of_union(spark, sf):
    """Union of two result lists that keeps the best row of a key."""
    li = table(spark, sf, "lineitem")
    a = li.groupBy("l_partkey").agg(F.max("l_discount").alias("score"))
    b = li.groupBy("l_partkey").agg(F.max("l_tax").alias("score"))
    return retrieval.best_per_key([a, b], ["l_partkey"], "score")


@query("union_append", "SELECT o_orderpriority AS tag, count(*) AS n FROM (SELECT o_orderpriority FROM orders UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1")
def union_append(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tag"))
    return a.union(table(spark, sf, "customer").select("c_mktsegment")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("custom_priority_top", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 20")
def custom_priority_top(spark, sf):
    """A report of 20 by custom priority."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(p, "o_orderkey").select("o_orderkey", "o_orderpriority").limit(20)


@query("latest_errors", "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def latest_errors(spark, sf):
    """A report of the 25 latest errors."""
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").select("event_id", "ts", "user_id").limit(25)


@query("best_of_n", "SELECT l_orderkey, max_by(l_linenumber, l_extendedprice * 100 - l_linenumber / 1000.0) AS best FROM lineitem GROUP BY 1")
def best_of_n(spark, sf):
    """Best candidate per group by score."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.col("l_extendedprice") * 100 - F.col("l_linenumber") / 1000.0).alias("best"))


@query("first_after_threshold", "SELECT user_id, min(ts) AS ts FROM events WHERE value > 90 GROUP BY 1")
def first_after_threshold(spark, sf):
    return table(spark, sf, "events").where("value > 90").groupBy("user_id").agg(F.min("ts").alias("ts"))


@query("top_neighbours", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def top_neighbours(spark, sf):
    """Top 3 per key, ties by the greater id."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("regressions", "SELECT l_orderkey AS case_id FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'O' AND l_returnflag = 'N') INTERSECT SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT bool_and(l_discount > 0.02)")
def regressions(spark, sf):
    """Cases that passed before and fail now."""
    from ..operators.evalmetrics import regressions as regress

    li = table(spark, sf, "lineitem")
    before = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("passed"))
    now = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.bool_and(F.col("l_discount") > 0.02).alias("passed"))
    return regress(before, now)


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc")
    )
