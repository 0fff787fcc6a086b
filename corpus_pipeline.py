"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontam, mixing, quality, secrets, simhash
from lodestone.llm.common import helper
from lodestone.session import materialize, table

#: SimHash, the conditional histograms and the slot checks have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from every language reference reject go."""
    kept = helper(docs, "_kept")
    verdicts = quality.quality(docs).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(F.col(kept)), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows where a text changes."""
    spans = helper(docs, "_spans")
    clean = secrets.redact(secrets.find_secrets(docs, out=spans), spans=spans)
    changed = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication towards the square root of each source's characters, shuffled globally."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("poisson_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
