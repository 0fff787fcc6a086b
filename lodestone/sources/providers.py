"""Injected providers: model-dependent columns (embeddings, extracted facts, judge scores) from a Python callable.

Nothing here reaches the network. A provider gets a list of texts and returns as many values; it is called in
batches inside Arrow-fed tasks. A failing batch gives nulls, so a run goes on without its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list]


def with_provided(df: DataFrame, text: str, name: str, kind: str, provider: Provider, batch: int = 64) -> DataFrame:
    """``df`` with a column ``name`` of type ``kind`` from the provider."""
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame[text]]
            out: list = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    got = list(provider(part))
                    if len(got) != len(part):
                        raise ValueError("the provider returned another number of values")
                except Exception:  # documents of a failed call have no value
                    got = [None] * len(part)
                out += got
            yield frame.assign(**{name: pd.Series(out, index=frame.index, dtype=object)})

    return df.mapInPandas(run, spec)


def unit_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows with a non-empty vector, scaled to length 1."""
    from pyspark.sql import functions as F

    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).withColumn(vec, F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))
