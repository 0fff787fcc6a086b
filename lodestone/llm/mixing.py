"""Mixing sources to target weights by Poisson replication.

A source with a share of all characters gets the mean repetition rate that brings its expected share
to its target weight. Each document draws its count from a Poisson distribution by inverting the
cumulative distribution at a uniform number hashed from the seed and the document's id, is exploded by
that count, and all copies are shuffled globally by another hash of id and copy number.

The uniform numbers are the first 52 bits of an MD5, and the distribution's steps are integers of
1e-12; so a run, a rerun after a lost executor and another engine agree on every count.

Defined results: a null text has no characters (but the document is drawn like any other), a null
source is a source of its own, rows with one id draw one count each and alike, an empty table gives an
empty result, a source that ``weights`` doesn't list has weight 0, columns of the input that are named
like an output give way. Copies of one document differ in ``copy_no`` (from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, partitions_for
from .common import helper, with_outputs

#: One Poisson draw covers a mean of at most this; a larger mean is the sum of several draws.
MEAN_PER_DRAW = 32.0
#: Integer steps of the cumulative distribution.
GRAIN = 10**12
#: Below this many sources the table of rates is broadcast (some 2 KB a source).
BROADCAST_SOURCES = 5_000


def uniform(seed: int, *parts: Column) -> Column:
    """A whole number from 0 to GRAIN-1, uniform by hash."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.floor(F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * F.lit(float(GRAIN))).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, scale: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: ``(source_key, chars, rate)``.

    Without ``weights`` a source's target weight is its characters to the power ``temperature``.
    ``scale`` is the size of the mixture in multiples of the corpus.
    """
    per = docs.groupBy(F.col(source).alias("source_key")).agg(F.sum(F.length(F.coalesce(text, F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        weight = F.when(F.col("chars") > 0, F.pow("chars", F.lit(float(temperature)))).otherwise(F.lit(0.0))
    else:
        weight = F.coalesce(*[F.when(F.col("source_key") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    per = materialize(per.withColumn("weight", weight), "sources")  # one pass over the texts, though the total needs it again
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.round(F.lit(float(scale)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars"), 9)
    return per.crossJoin(F.broadcast(total)).select("source_key", "chars", F.coalesce(F.when(F.col("chars") > 0, rate), F.lit(0.0)).alias("rate"))  # total: one row


def with_steps(rates: DataFrame) -> DataFrame:
    """Adds the number of draws and the cumulative distribution of one draw, in GRAIN-ths."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW)).cast("int")
    df = rates.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 16).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.floor(F.exp(-F.col("mean")) * GRAIN + 0.5).cast("long")).alias("steps"))

    def step(s: Column, k: Column) -> Column:
        p = s.p * F.col("mean") / k
        return F.struct(p.alias("p"), (s.c + p).alias("c"), F.concat(s.steps, F.array(F.floor((s.c + p) * GRAIN + 0.5).cast("long"))).alias("steps"))

    return df.withColumn("steps", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.steps))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 42, source: str = "source", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Explodes documents by their Poisson counts and shuffles the copies globally."""
    own = {n: helper(docs, f"_mix_{n}") for n in ("source", "draws", "steps", "n", "copy")}
    steps = with_steps(rates).select(F.col("source_key").alias(own["source"]), F.col("draws").alias(own["draws"]), F.col("steps").alias(own["steps"]))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(steps) if few else steps, docs[source].eqNullSafe(F.col(own["source"])), "inner")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(own["draws"])), F.lit(0), lambda n, j: n + F.size(F.filter(own["steps"], lambda c: c <= uniform(seed, F.col(key), j)))
    )
    drawn = joined.withColumn(own["n"], count).where(F.col(own["n"]) > 0)
    copies = drawn.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["n"]))))
    out = with_outputs(copies, {"copy_no": F.col(own["copy"]), "mix_key": uniform(seed + 1, F.col(key), F.col(own["copy"]))}, drop=own.values())
    # The key is uniform by construction: its range is cut evenly, without a sampling pass.
    n = partitions or partitions_for(docs)
    by = F.floor(F.col("mix_key") * F.lit(float(n)) / F.lit(float(GRAIN))).cast("int")
    return out.repartitionById(n, by).sortWithinPartitions("mix_key", key, "copy_no")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """The operator: rates from all documents, then Poisson replication and the global shuffle."""
    return replicate(docs, source_rates(docs, weights, temperature, scale), seed)
