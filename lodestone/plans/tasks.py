"""Task graph, queue and audit operations, over ``orders`` as tasks and ``events`` as updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores
from ..session import table
from .registry import query

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END"
TASKS = f"t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, {STATUS} AS status, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS assigned_to, o_orderdate AS created_at, o_orderdate AS updated_at, o_custkey AS parent FROM orders)"


def tasks(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    who = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), s.alias("status"), who.alias("assigned_to"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_custkey").alias("parent")
    )


@query("list_by_status", f"WITH {TASKS} SELECT id, status, assigned_to FROM t WHERE status = 'pending' AND assigned_to = '2-HIGH'")
def list_by_status(spark, sf):
    return tasks(spark, sf).where("status = 'pending' AND assigned_to = '2-HIGH'").select("id", "status", "assigned_to")


@query("pick_next", f"WITH {TASKS} SELECT id, created_at FROM t WHERE status = 'pending' AND (assigned_to IS NULL OR assigned_to = '1-URGENT') ORDER BY created_at, id LIMIT 1")
def pick_next(spark, sf):
    """The oldest free task: a limit that is the feature."""
    return stores.next_task(tasks(spark, sf), "1-URGENT").select("id", "created_at")


@query("task_children", f"WITH {TASKS} SELECT parent, count(*) AS n, string_agg(id, ',' ORDER BY id) AS children FROM t GROUP BY 1")
def task_children(spark, sf):
    """Children of every parent through ``parent_of`` edges."""
    t = tasks(spark, sf)
    edges = t.select(F.col("parent").alias("from_id"), F.lit("parent_of").alias("edge_type"), F.col("id").alias("to_id"))
    j = t.select("id").join(edges.where("edge_type = 'parent_of'"), F.col("id") == F.col("to_id"))
    return j.groupBy(F.col("from_id").alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))


@query("queue_status", f"WITH {TASKS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error FROM t")
def queue_status(spark, sf):
    return stores.queue_status(tasks(spark, sf))


@query(
    "status_updates",
    f"""WITH {TASKS}, u AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'lost' ELSE 'blocked' END AS s, l_shipdate AS moment FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment DESC, s) AS k FROM u WHERE s <> 'lost')
SELECT t.id, coalesce(k.s, t.status) AS status, coalesce(k.moment, t.updated_at) AS updated_at FROM t LEFT JOIN k ON t.id = k.id AND k.k = 1""",
)
def status_updates(spark, sf):
    """Validated status changes; the latest of a task wins."""
    s = F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "R", "lost").otherwise("blocked")
    u = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), s.alias("status"), F.col("l_shipdate").alias("at"))
    return stores.set_status(tasks(spark, sf), u).select("id", "status", "updated_at")


@query("keyed_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def keyed_upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return stores.upsert(c, s, ["c_custkey"])


@query("insert_ignore", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return stores.insert_ignore(s, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("partial_update", "SELECT c_custkey, coalesce(s_name, c_name) AS c_name, c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def partial_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return stores.partial_update(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), "c_custkey")


@query("dedup_counter", "SELECT user_id, event_type, count(*) AS n, max(ts) AS updated_at, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def dedup_counter(spark, sf):
    """Counter upsert: repeated (key, symptom) rows become one with a count."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("updated_at"), F.min("event_id").alias("first_id"))


@query(
    "advanced_merge",
    "SELECT user_id, ['pending', 'running', 'error', 'done'][max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)] AS status FROM events WHERE event_type <> 'signup' GROUP BY 1",
)
def advanced_merge(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'signup'")
    s = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "error").otherwise("done")
    return stores.advanced_merge(e.select("user_id", s.alias("status")), "user_id")


@query("priority_bump", "SELECT o_custkey, max(o_totalprice) AS priority FROM orders GROUP BY 1")
def priority_bump(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("priority"))


@query("audit_log", "SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('error', 'purchase') GROUP BY 1, 2")
def audit_log(spark, sf):
    """Audit query by actor, intent and time."""
    e = table(spark, sf, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & F.col("event_type").isin("error", "purchase"))
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ready_tasks",
    f"WITH {TASKS}, d AS (SELECT id, parent, lag(id) OVER (PARTITION BY parent ORDER BY created_at, id) AS dep FROM t) SELECT t.id FROM t JOIN d ON t.id = d.id LEFT JOIN t p ON d.dep = p.id WHERE t.status = 'pending' AND (d.dep IS NULL OR p.status = 'done')",
)
def ready_tasks(spark, sf):
    """Pending tasks whose dependency (the parent's task before) is done."""
    from pyspark.sql import Window

    t = tasks(spark, sf)
    dep = F.lag("id").over(Window.partitionBy("parent").orderBy("created_at", "id"))
    return stores.ready(t.withColumn("depends_on", F.filter(F.array(dep), lambda x: x.isNotNull()))).select("id")


@query("group_for_crystals", f"WITH {TASKS} SELECT coalesce(CAST(parent AS VARCHAR), assigned_to, '_ungrouped') AS grp, count(*) AS n FROM t WHERE status = 'done' AND created_at < TIMESTAMP '1998-07-01' GROUP BY 1 HAVING count(*) >= 2")
def group_for_crystals(spark, sf):
    t = tasks(spark, sf).where((F.col("status") == "done") & (F.col("created_at") < F.lit("1998-07-01").cast("timestamp")))
    return t.groupBy(F.coalesce(F.col("parent").cast("string"), "assigned_to", F.lit("_ungrouped")).alias("grp")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("folder_hashes", "SELECT source AS folder, md5(string_agg(source || '/' || doc_id || '.txt:' || md5(text), chr(10) ORDER BY source || '/' || doc_id || '.txt')) AS folder_hash FROM documents GROUP BY 1")
def folder_hashes(spark, sf):
    f = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.md5("text").alias("hash"))
    return stores.folder_hashes(f)
