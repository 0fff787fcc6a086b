"""What the operators of this package share: row packing, word splitting, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import input_bytes

#: Java pattern of the characters between words: space and the ASCII controls 09 to 0D.
GAP = r"[\x20\x09-\x0D]+"


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes: ``bytes.split`` splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def with_outputs(df: DataFrame, outputs: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with computed columns; an input column of the same name (in any case) gives way."""
    taken = {x.lower() for x in outputs} | {x.lower() for x in drop}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[v.alias(k) for k, v in outputs.items()])


def helper(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_out(df: DataFrame, small: int = 16 << 20) -> DataFrame:
    """A small table, which may lie in one file and so in one task, dealt over all cores; a larger one as it is."""
    size = input_bytes(df)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size is not None and size < small else df


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    size = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that memory stays bounded."""
    at_most = max(1, most)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // n)
        step = max(1, at_most // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)
