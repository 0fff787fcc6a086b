"""Expected values of single functions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc, text as tx
from lodestone.operators import evalmetrics, graph, ontology, sampling, similarity, stores
from lodestone.sources import files, sinks


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("node_modules/", "node_modules/a/b.js", True),
        ("node_modules/", "x/node_modules/a.js", True),
        ("dist/", "dist/x", True),
        ("dist/", "distant/x", False),
        ("*.log", "a.log", True),
        ("*.log", "deep/a.log", True),
        ("*.log", "a.logs", False),
        ("src/**/*.ts", "src/a/b.ts", True),
        ("src/**/*.ts", "src/b.ts", True),
        ("src/**/*.ts", "lib/b.ts", False),
    ],
)
def test_globs(pattern, path, hit):
    assert bool(re.match(tx.glob_regex(pattern), path)) is hit


def test_md5(spark):
    assert value(spark, F.md5(F.lit("test content"))) == "9473fdd0d880a43c21b7778d34872157"


def test_content_words(spark):
    assert value(spark, tx.content_words(F.lit("the quick brown dog"))) == ["quick", "brown", "dog"]
    assert value(spark, tx.content_words(F.lit("The DOG."))) == ["dog"]
    assert value(spark, tx.content_words(F.lit("the of"))) == []


def test_identifiers(spark):
    assert value(spark, tx.surface_id(F.lit("Memory"))) == "surface::memory"
    assert value(spark, tx.canonical_node_id(F.array().cast("array<string>"), "subject")) == "subject:unknown"
    assert value(spark, tx.canonical_node_id(F.array(F.lit("b"), F.lit("a")), "x")) == "a+b"
    assert value(spark, tx.pos_of_synset(F.lit("dog.n.01"))) == "n"
    assert value(spark, tx.triplet_text(F.lit("a"), F.lit(""), F.lit("c"))) == "a | c"


def test_normalising(spark):
    assert value(spark, tx.normalize_phrase(F.lit("[[Deep Dive]] `code` [x](y) _a_-b"))) == "deep dive code x a b"
    assert value(spark, tx.strip_boilerplate(F.lit("---\na: 1\n---\n# T\nbody\n\n\n\nend\n"))) == "body\n\nend"
    assert value(spark, tx.line_feeds(F.lit("a\r\nb\rc"))) == "a\nb\nc"


def test_jaccard(spark):
    t = spark.createDataFrame([(1, "owns memory"), (1, "uses graph"), (2, "owns memory"), (2, "routes tasks")], "k int, f string")
    r = similarity.set_jaccard(t, "k", "f").first()
    assert (r["overlap"], r["union"]) == (1, 3) and r["score"] == pytest.approx(1 / 3)


def test_fusion(spark):
    assert value(spark, similarity.fuse(F.lit(0.0), F.lit(1.0), F.lit(True))) == pytest.approx(0.3)
    assert value(spark, similarity.fuse(F.lit(0.5), F.lit(1.0), F.lit(False))) == 0.5
    assert value(spark, similarity.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0


def test_votes(spark):
    v = spark.createDataFrame([("g", 0.65, False, ["Missing error handling", "No type hints"]), ("g", 0.75, True, []), ("g", 0.80, True, [])], "g string, score double, passed boolean, issues array<string>")
    r = evalmetrics.votes(v, "g").first()
    assert r["mean_score"] == pytest.approx(0.733333) and r["passed"] and r["agreement"] == pytest.approx(0.666667) and r["decision"] == "ACCEPT"


def test_normal_cdf(spark):
    for z in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert value(spark, sc.normal_cdf(F.lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-7)


def test_yeo_johnson_round_trip(spark):
    for lam in (0.0, 0.5, 2.0):
        for x in (-1.5, 0.0, 2.0):
            assert value(spark, sc.inverse_yeo_johnson(sc.yeo_johnson(F.lit(x), lam), lam)) == pytest.approx(x, abs=1e-9)


def test_chains_cover_each_node_once(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (4, 5, 0.35), (5, 6, 0.2)], "a long, b long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    rows = graph.greedy_chains(e, graph.components(nodes, e)).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5, 6]  # a node without a chain is one of its own
    assert sorted((r["place"], r["id"]) for r in rows if r["chain"] == 1) == [(0, 1), (1, 2), (2, 3)]


def test_components_of_no_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, graph.components(nodes, spark.createDataFrame([], "a long, b long, w double")).collect())) == [(1, 1), (2, 2)]


def test_betweenness_of_a_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, w double")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, e).collect()}
    assert got == {1: 0.0, 2: pytest.approx(2 / 3, abs=1e-6), 3: pytest.approx(2 / 3, abs=1e-6), 4: 0.0}


def test_triplets(spark):
    raw = spark.createDataFrame([(1, '[{"subject":"a","predicate":"b","object":"c"},{"subject":"a","predicate":"b"},{"subject":"d","predicate":"e","object":""}]'), (2, "no json")], "id int, raw string")
    assert len(ontology.parse_triplets(raw).collect()) == 2
    with pytest.raises(ValueError):
        ontology.zip_rows(spark.range(2).withColumnRenamed("id", "pos"), spark.range(3).withColumnRenamed("id", "pos"))


def test_salvage(spark):
    raw = spark.createDataFrame([(1, 'noise [{"a": 1}, {"b": {"c": 2}}, {"d": '), (2, None)], "id int, raw string")
    assert [r["object"] for r in files.salvage_json(raw, "raw", "id").collect()] == ['{"a": 1}', '{"b": {"c": 2}}']


def test_weighted_sample(spark):
    df = spark.range(500)
    a = [r["id"] for r in sampling.weighted_sample(df, "id", F.lit(1.0), 50).collect()]
    assert len(set(a)) == 50 and sorted(a) == sorted(r["id"] for r in sampling.weighted_sample(df.repartition(7), "id", F.lit(1.0), 50).collect())


def test_anchor_pack(spark):
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate([10, 5, 5, 3, 0])], "g string, id long, size long")
    assert {r["id"]: r["batch"] for r in sampling.anchor_pack(df, "id", "size", 10, "g").collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_versioned_writes(spark):
    u = spark.createDataFrame([("k", 1, 0, "a"), ("k", 2, 0, "b"), ("k", 3, 1, "c"), ("k", 4, 3, "d")], "id string, seq long, expected long, v string")
    assert sorted(r["v"] for r in stores.versioned_apply(u, "id").collect()) == ["a", "c"]


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = str(tmp_path / "t")
    sinks.write_upsert(one, path, ["id"])
    sinks.write_upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    text = spark.range(1).select(sinks.replace_block(F.lit("x"), "n", F.lit("body")).alias("t"))
    again = text.select(sinks.replace_block(F.col("t"), "n", F.lit("body")).alias("u"), "t").first()
    assert again["u"] == again["t"]


def test_file_sources(spark, tmp_path):
    for name, body in (("alpha/SKILL.md", "s"), ("alpha/DESCRIPTION.md", "d"), ("alpha/notes.md", "n"), ("alpha/references/ref.md", "r"), ("disabled/SKILL.md", "x")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    f = files.text_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "(alpha/.*)$", 1)).withColumn("g", F.lit(1))
    doc = files.composite(f.withColumn("place", files.ordered_key("path")), "g").first()
    assert doc["files"] == ["alpha/SKILL.md", "alpha/DESCRIPTION.md", "alpha/notes.md", "alpha/references/ref.md"]
    assert doc["text"].startswith("=== FILE: alpha/SKILL.md ===\ns\n\n")


def test_diagnostics_and_logs(spark):
    raw = spark.createDataFrame([('[{"path":"a.py","line":3,"column":1,"type":"error","message":"m","symbol":"s"}]',), ("broken",)], "j string")
    assert files.diagnostics(raw, "j").count() == 1
    lines = spark.createDataFrame([('{"a": 1}',), ("nope",)], "value string")
    assert files.event_log(lines, "a int").where("a IS NOT NULL").count() == 1
    py = spark.createDataFrame([("m.py", "import os\nclass A:\n    def f(self): pass\n"), ("bad.py", "def (")], "path string, content string")
    assert {(r["kind"], r["name"]) for r in files.python_symbols(py).collect()} == {("import", "os"), ("class", "A"), ("function", "f")}


def test_task_operations(spark):
    tasks = spark.createDataFrame([("a", "A", "", "pending", None, None, 1.0, 1.0)], "id string, title string, description string, status string, assigned_to string, result string, created_at double, updated_at double")
    edges = spark.createDataFrame([], "from_id string, edge_type string, to_id string")
    new = spark.createDataFrame([("b", "B", "", "a", 2.0), ("a", "again", "", None, 2.0)], "id string, title string, description string, parent_id string, at double")
    tasks, edges = stores.create_tasks(tasks, edges, new)
    assert sorted((r["id"], r["title"]) for r in tasks.collect()) == [("a", "A"), ("b", "B")]
    assert [r["id"] for r in stores.children(tasks, edges, "a").collect()] == ["b"]
    tasks, edges = stores.assign_tasks(tasks, edges, spark.createDataFrame([("b", "x", 3.0), ("b", "y", 4.0)], "id string, who string, at double"))
    tasks = stores.write_results(tasks, spark.createDataFrame([("b", "fine", 5.0)], "id string, result string, at double"))
    got = {r["id"]: r for r in stores.tasks_with_edges(tasks, edges).collect()}
    assert (got["b"]["assigned_to"], got["b"]["result"], got["b"]["updated_at"], got["b"]["edges"]) == ("y", "fine", 5.0, ["assigned_to:y"]) and got["a"]["edges"] == ["parent_of:b"]
    assert {r["status"] for r in stores.cancel(tasks).collect()} == {"cancelled"}


def test_todo_operations(spark):
    t = spark.createDataFrame([(1, "x", "low", "p", 0), (2, "y", "high", "p", 0), (3, "z", "normal", "q", 1)], "id long, task string, priority string, project string, done int")
    assert [r["id"] for r in stores.list_todos(t, "p").collect()] == [2, 1]
    done = stores.change_rows(t, spark.createDataFrame([(1, 1)], "id long, done int"))
    assert {r["id"]: r["done"] for r in done.collect()}[1] == 1
    with pytest.raises(KeyError):
        stores.delete_rows(t, spark.createDataFrame([(9,)], "id long"))


def test_incremental_runs(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, content_hash string")
    cache = spark.createDataFrame([("a", "1", [1.0]), ("b", "9", [1.0]), ("c", "3", [])], "name string, content_hash string, embedding array<double>")
    assert sorted(r["name"] for r in stores.pending_derivations(docs, cache).collect()) == ["b", "c"]


def test_providers(spark):
    from lodestone.sources import providers

    d = spark.createDataFrame([(1, "ab"), (2, "boom"), (3, None)], "id long, text string")

    def lengths(texts):
        if "boom" in texts:
            raise RuntimeError
        return [float(len(t)) for t in texts]

    got = {r["id"]: r["n"] for r in providers.with_provided(d.coalesce(1), "text", "n", "double", lengths, batch=1).collect()}
    assert got == {1: 2.0, 2: None, 3: 0.0}
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [])], "id long, v array<double>")
    assert [r["v"] for r in providers.unit_vectors(v, "v").collect()] == [[0.6, 0.8]]


def test_quotas(spark):
    z = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-1.5, -0.2, 0.1, 0.4, 2.0])], "id long, z double")
    q = {r["id"]: r["quota"] for r in sampling.cdf_quotas(z, "z", "id", 40).collect()}
    assert sum(q.values()) == 40 and min(q.values()) >= 1
    r = sampling.reject_resample(spark.range(4000).withColumn("c", F.col("id") % 2), spark.createDataFrame([(0, 0.8), (1, 0.2)], "c long, p double"), "c", "id")
    n = {x["c"]: x["count"] for x in r.groupBy("c").count().collect()}
    assert n[0] == 2000 and abs(n[1] - 500) < 80


def test_file_selection(spark):
    from lodestone.operators import selection

    rows = spark.createDataFrame([(p,) for p in ("src/a.py", "src/x/b.py", "dist/a.py", "docs/keep.md", "docs/b.md")], "path string")
    got = {r["path"]: r["s"] for r in rows.select("path", selection.select_files(F.col("path"), ["src/**"], ["docs/*.md"], ["dist/"], ["docs/keep.md"]).alias("s")).collect()}
    assert got == {"src/a.py": True, "src/x/b.py": True, "dist/a.py": False, "docs/keep.md": True, "docs/b.md": False}


def test_greedy_selection(spark):
    from lodestone.operators import latent, selection

    c = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, score double, vec array<double>")
    assert [r["doc_id"] for r in selection.mmr(c, 2, 0.5).orderBy("place").collect()] == [1, 3]
    assert selection.rouge_l("a b c d", "a c d") == pytest.approx(6 / 7)
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 3))
    assert latent.canonical_correlations(x, x @ np.array([[2.0, 1, 0], [0, 1, 0], [0, 0, 3]])) == pytest.approx([1, 1, 1])


def test_rouge_candidates_are_lossless(spark):
    import random

    from lodestone.operators import selection as sel

    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(60)] + ["the same item again"] * 8 + [None, "", " x y "]
    rows = list(enumerate(texts))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and sel.rouge_l(a or "", b or "") >= 0.7}
    got = {tuple(r) for r in sel.rouge_candidates(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert want <= got and len(got) < 71 * 70 / 2
    assert {(i, j) for i in range(60, 68) for j in range(i + 1, 68)} <= got
