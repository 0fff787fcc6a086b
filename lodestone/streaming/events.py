"""Structured Streaming forms: windows, watermarks, idempotent keyed upserts, stalls and queue states.

The same transformations run on batch frames. ``run_now`` drains a stream (``availableNow``) into tables
of the shared folder: a restart resumes from the checkpoint, and a replayed batch overwrites its own table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder, ship

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    ship(spark)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet")


def run_now(stream: DataFrame, mode: str = "complete", batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drains the stream and returns its table: the last batch's (complete, update with ``batch``) or all batches' (append)."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/lodestone-stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def write(df: DataFrame, n: int) -> None:
        path = f"{root}/batch-{n}"
        (batch(df) if batch else df).write.mode("overwrite").parquet(path)
        if path not in written:
            written.append(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*(written[-1:] if mode == "complete" else written))


def typed(rows: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    """Rows as a frame whose columns have their types even where there are no rows."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=k) for i, (c, k) in enumerate(kinds.items())})


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped by the stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), "n")


def heartbeats(events: DataFrame) -> DataFrame:
    """Latest time per key: idempotent, so replays don't matter."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def first_submissions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Idempotent submit: one row per (key, type) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def stall_alerts(events: DataFrame, limit_s: float = 100_000.0) -> DataFrame:
    """Per key, gaps over the limit between neighbouring events, with the last time as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        ts = sorted(t.value // 1000 for f in frames for t in f["ts"])  # microseconds
        rows = []
        for t in ts:
            if last is not None and (t - last) / 1e6 > limit_s:
                rows.append((key[0], pd.Timestamp(t, unit="us"), (t - last) / 1e6))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield typed(rows, {"user_id": "int64", "ts": "datetime64[us]", "gap": "float64"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp, gap double", "last bigint", "append", GroupStateTimeout.NoTimeout)


def queue_states(events: DataFrame) -> DataFrame:
    """Latest state of each key in an update stream."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


def repeat_streaks(events: DataFrame, least: int = 4) -> DataFrame:
    """Per key, the moment an event type comes for the ``least``-th time in a row; the run is the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, n = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            n = n + 1 if r.event_type == kind else 1
            kind = r.event_type
            if n == least:
                rows.append((key[0], r.ts, kind))
        state.update((kind, n))
        yield typed(rows, {"user_id": "int64", "ts": "datetime64[us]", "event_type": "object"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp, event_type string", "kind string, n int", "append", GroupStateTimeout.NoTimeout)
