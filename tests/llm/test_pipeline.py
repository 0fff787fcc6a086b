"""The corpus pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, quality, secrets, simhash
from lodestone.session import materialize, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DIR, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "poisson_mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, DIR), name)
        assert after.columns == docs.columns
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.quality(before).where("kept").collect()}
        elif name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        elif name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in decontam.contaminated(before, table(spark, DIR, "benchmark")).collect()}
            want = {r["doc_id"] for r in before.collect()} - bad
        else:
            want = {r["doc_id"] for r in before.collect()}
            assert secrets.find_secrets(after).where("size(secrets) > 0").count() == 0
            assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()
        assert {r["doc_id"] for r in after.collect()} == want
        before = after
    out = corpus_pipeline.run(spark, DIR)
    kept = {r["doc_id"] for r in before.collect()}
    assert {r["doc_id"] for r in out.collect()} <= kept


def test_stages_of_edges(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "w " * 60, "en", "a", 1), (7, "x y z " * 3000, "en", "a", 6000), (7, "x y z " * 3000, "en", "a", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).collect()
        assert stage(spark, docs.limit(0), DIR).collect() == []


def test_stages_keep_clashing_columns(spark):
    """Columns named like the stages' outputs and helpers come back as they were."""
    names = ["secrets", "_n", "_kept", "_lead", "_base", "_BASE_", "_spans", "_mix_source", "_mix_n", "_key", "_text", "kept", "component_id"]
    text = " ".join(f"word{i}" for i in range(80)) + " password = Abcdefgh12 "
    docs = spark.createDataFrame([(i, text + str(i), "en", "a", len(text)) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(f"own {n} "), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DIR).collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"own {n} {r['doc_id']}" for n in names), name
        if name == "secret_scan":
            assert all("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
