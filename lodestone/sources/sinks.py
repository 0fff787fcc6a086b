"""Sinks: keyed upserts and snapshots written as one commit each, reports, delimited blocks, indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import stores


def write_upsert(rows: DataFrame, path: str, key: list[str]) -> str:
    """The table at ``path`` with ``rows`` replaced by key. The new table is written beside the old one, then swapped in."""
    from .files import table_or_empty

    spark = rows.sparkSession
    old = table_or_empty(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    return _swap(stores.upsert(old, rows, key), path)


def write_snapshot(df: DataFrame, path: str) -> str:
    """Full refresh: readers see the old table or the new one."""
    return _swap(df, path)


def _swap(df: DataFrame, path: str) -> str:
    """Writes beside the table, moves the old one aside, the new one in, and only then deletes the old one.

    If a step fails, the old table is moved back. Between the two moves, which are renames, readers see none.
    """
    spark = df.sparkSession
    fresh, aside = f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, at, back = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, aside))
    fs = at.getFileSystem(conf)
    held = fs.exists(at)
    if held and not fs.rename(at, back):
        raise OSError(f"{path} can't be moved; the new table is at {fresh}")
    if not fs.rename(new, at):
        if held:
            fs.rename(back, at)
        raise OSError(f"{fresh} can't be moved to {path}")
    if held:
        fs.delete(back, True)
    return path


def write_checkpoint(state: DataFrame, log: DataFrame, path: str) -> None:
    """State overwritten, one log row appended."""
    write_snapshot(state, f"{path}/state")
    log.write.mode("append").parquet(f"{path}/run_log")


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Inverted index ``(term, docs)`` partitioned by a hash of the term, so a lookup reads one bucket."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def json_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def nested_report(df: DataFrame, by: list[str]) -> DataFrame:
    """One JSON text for each group, with the other columns of its rows listed in order: ``(by..., json)``."""
    inner = F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in by])))
    return df.groupBy(*by).agg(inner.alias("rows")).select(*by, F.to_json(F.struct(*by, "rows")).alias("json"))


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of at most ``limit`` rows; a last line says how many were left out."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    more = [f"\n{df.count() - limit} more rows"] if len(rows) > limit else []
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows[:limit]), *more])


def mermaid(edges: DataFrame, limit: int = 60) -> str:
    """Dependency edges as a diagram, softly capped."""
    rows = edges.orderBy("src", "dst").limit(limit).collect()
    return "\n".join(["graph LR", *(f"  {r['src']} --> {r['dst']}" for r in rows)])


def replace_block(text: Column, name: str, body: Column) -> Column:
    """Text with the block between ``name`` marks replaced, or appended: doing it twice changes nothing."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = F.concat(F.lit(start + "\n"), body, F.lit("\n" + end))
    at = F.instr(text, start)
    stop = F.instr(text, end)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), block, F.substr(text, stop + len(end)))
    return F.when((at > 0) & (stop > at), swapped).otherwise(F.concat(text, F.lit("\n\n"), block))
