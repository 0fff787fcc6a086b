"""Keyed tables: snapshot and three-way diffs, upserts, task graph, queue and audit operations.

Tables are values: each operation returns the new table, to be written by the caller in one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATUSES = ("pending", "running", "blocked", "done", "error", "cancelled")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """``(key, change)`` with new, removed or modified."""
    o, n = old.select(key, F.col(mark).alias("_o"), F.lit(True).alias("_in_old")), new.select(key, F.col(mark).alias("_n"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def path_prefixes(path: Column) -> Column:
    """All folders above a path, ``.`` for the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    deep = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.concat(F.array(F.lit(".")), deep)


def folder_hashes(files: DataFrame, path: str = "path", mark: str = "hash") -> DataFrame:
    """MD5 over the sorted ``path:hash`` lines of the files directly in each folder."""
    folder = F.when(F.contains(F.col(path), F.lit("/")), F.regexp_replace(F.col(path), "/[^/]*$", "")).otherwise(".")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(mark).alias("h")))), lambda x: F.concat(x.p, F.lit(":"), x.h)), "\n")
    return files.groupBy(folder.alias("folder")).agg(F.md5(lines).alias("folder_hash"))


def three_way(base: DataFrame, master: DataFrame, mirror: DataFrame, key: str, mark: str) -> DataFrame:
    """Sync case per key: noop, ff-mirror, ff-master, conflict; without a base equal sides are noop."""
    paths = master.select(key).union(mirror.select(key)).union(base.select(key)).distinct()
    j = paths
    for name, t in (("_b", base), ("_m", master), ("_r", mirror)):
        j = j.join(t.select(key, F.col(mark).alias(name)), key, "left")
    b, m, r = F.col("_b"), F.col("_m"), F.col("_r")
    case = F.when(m.eqNullSafe(r), "noop").when(b.isNull(), "conflict").when(r.eqNullSafe(b), "ff-mirror").when(m.eqNullSafe(b), "ff-master").otherwise("conflict")
    return j.select(key, case.alias("sync_case"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` replace the rows of the same key; columns missing on one side are null."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key is new are added, one a key."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of ``changes`` replace those of the table's row."""
    names = [c for c in changes.columns if c != key]
    j = table.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def set_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes ``(id, status, at)`` of known statuses; the latest of a task wins."""
    good = latest(changes.where(F.col("status").isin(*STATUSES)), ["id"], [F.desc("at"), F.col("status")])
    j = tasks.join(good.select("id", F.col("status").alias("_s"), F.col("at").alias("_at")), "id", "left")
    return j.withColumn("status", F.coalesce("_s", "status")).withColumn("updated_at", F.coalesce("_at", "updated_at")).select(*tasks.columns)


def create_tasks(tasks: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tasks ``(id, title, description, parent_id, at)`` as pending; a parent gives a ``parent_of`` edge, once."""
    rows = new.select("id", "title", "description", F.lit("pending").alias("status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    links = new.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("from_id"), F.lit("parent_of").alias("edge_type"), F.col("id").alias("to_id"))
    return insert_ignore(tasks, rows, ["id"]), insert_ignore(edges, links, ["from_id", "edge_type", "to_id"])


def assign_tasks(tasks: DataFrame, edges: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments ``(id, who, at)``: the latest of a task wins; its old ``assigned_to`` edges go."""
    last = latest(assigned, ["id"], [F.desc("at"), F.col("who")])
    done = partial_update(tasks, last.select("id", F.col("who").alias("assigned_to"), F.col("at").alias("updated_at")), "id")
    old = last.select(F.col("id").alias("from_id"), F.lit("assigned_to").alias("edge_type"))
    links = last.select(F.col("id").alias("from_id"), F.lit("assigned_to").alias("edge_type"), F.col("who").alias("to_id"))
    return done, edges.join(old, ["from_id", "edge_type"], "left_anti").unionByName(links)


def write_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Results ``(id, result, at)`` written to their tasks."""
    return partial_update(tasks, results.select("id", "result", F.col("at").alias("updated_at")), "id")


def tasks_with_edges(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each task with its outgoing edges as an array of ``type:target``."""
    out = edges.groupBy(F.col("from_id").alias("_id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "edge_type", "to_id"))).alias("edges"))
    return tasks.join(out, tasks["id"] == out["_id"], "left").drop("_id").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))


def blocked(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'blocked'").orderBy(F.desc("updated_at"), "id")


def cancel(queue: DataFrame) -> DataFrame:
    """Pending and running work is marked cancelled; what runs may still finish and then overwrite the mark."""
    return queue.withColumn("status", F.when(F.col("status").isin("pending", "running"), "cancelled").otherwise(F.col("status")))


def submit(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Idempotent by name and content hash."""
    return insert_ignore(queue, rows, ["skill_name", "content_hash"])


def list_todos(todos: DataFrame, project: str | None = None, with_done: bool = False) -> DataFrame:
    """Open todos (of a project), high before normal before the rest, then by id."""
    rows = todos if with_done else todos.where("done = 0")
    rows = rows if project is None else rows.where(F.col("project") == project)
    return rows.orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2), "id")


def change_rows(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Partial update that refuses keys the table doesn't have."""
    missing = changes.join(table, key, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} unknown keys")
    return partial_update(table, changes, key)


def delete_rows(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows without those keys; unknown keys are refused."""
    if keys.join(table, key, "left_anti").count():
        raise KeyError("unknown keys")
    return table.join(keys.select(key), key, "left_anti")


def pending_derivations(documents: DataFrame, cache: DataFrame, key: str = "name") -> DataFrame:
    """Documents whose hash the cache lacks, or has without a vector: what an incremental run recomputes."""
    good = cache.where(F.size("embedding") > 0).select(key, "content_hash")
    return documents.join(good, [key, "content_hash"], "left_anti")


def children(tasks: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    return tasks.join(edges.where((F.col("edge_type") == "parent_of") & (F.col("from_id") == parent)), tasks["id"] == edges["to_id"]).select(tasks["*"])


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies (``depends_on`` array) are done."""
    done = tasks.where("status = 'done'").select(F.col("id").alias("dep"), F.lit(1).alias("ok"))
    open_ = tasks.select("id", F.explode("depends_on").alias("dep")).join(done, "dep", "left").where("ok IS NULL").select("id").distinct()
    return tasks.where("status = 'pending'").join(open_, "id", "left_anti")


def next_task(tasks: DataFrame, who: str) -> DataFrame:
    """The oldest pending task that is free or assigned to ``who``."""
    return tasks.where((F.col("status") == "pending") & (F.col("assigned_to").isNull() | (F.col("assigned_to") == who))).orderBy("created_at", "id").limit(1)


def queue_status(queue: DataFrame) -> DataFrame:
    """One row of counts by state, in one pass."""
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "error")])


def advanced_merge(updates: DataFrame, key: str, order: tuple[str, ...] = ("pending", "running", "error", "done")) -> DataFrame:
    """The most advanced status of each key wins, whatever the time."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    return updates.groupBy(key).agg(F.max_by("status", rank).alias("status"))


def versioned_apply(updates: DataFrame, key: str, version: str = "expected", order: str = "seq") -> DataFrame:
    """Optimistic writes in order: one is accepted if it expects the number of accepted writes before it.

    For expected versions that start at 0 that is the first write (by ``order``) of each expected version,
    as long as no version below is missing.
    """
    first = latest(updates, [key, version], [F.col(order)])
    w = Window.partitionBy(key).orderBy(version)
    dense = first.withColumn("_place", F.row_number().over(w) - 1).withColumn("_late", F.max(order).over(w.rowsBetween(Window.unboundedPreceding, 0)) == F.col(order))
    ok = F.min(((F.col("_place") == F.col(version)) & F.col("_late")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumn("_ok", ok).where("_ok = 1").drop("_place", "_late", "_ok")


def interval_at(states: DataFrame, moments: DataFrame, key: str, at: str) -> DataFrame:
    """The state valid at each moment: ``valid_from <= at < valid_to``, an open end is current."""
    s = states.withColumnRenamed(key, "_k")
    hit = (F.col("_k") == F.col(key)) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return moments.join(s, hit).drop("_k")


def daily_states(events: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Intervals ``(key, state, valid_from, valid_to)``: each event's state lasts to the key's next event."""
    w = Window.partitionBy(key).orderBy(ts, state)
    return events.select(key, F.col(state).alias("state"), F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to"))
