"""Library queries without SQL against plain Python over the same tables. ``COVERED`` names them for test_oracles."""

import itertools
import json
import math
import re
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.functions import scoring, text as tx
from lodestone.operators import cluster, graph, latent, retrieval, sampling, selection, similarity
from lodestone.session import table
from lodestone.sources import files, sinks

DIR = "/root/testdata/sf0.001"
#: Tested elsewhere: max_sim_spans, rouge_gate (test_spans, test_functions), kmeans_elbow (test_elbow).
COVERED = {"max_sim_spans", "rouge_gate", "kmeans_elbow"}


def covers(*names):
    COVERED.update(names)
    return lambda test: test


def rows(spark, name):
    return plans.QUERIES[name](spark, DIR).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    got = table(spark, DIR, "embeddings").orderBy("vec_id").toPandas()
    m = np.array([np.asarray(x, dtype=float) for x in got["embedding"]])
    return got["vec_id"].tolist(), m, got["label"].tolist()


@pytest.fixture(scope="module")
def cosines(vectors):
    ids, m, _ = vectors
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(u @ u.T, 6) + 0.0


def edges_above(ids, cosines, tau):
    return [(ids[i], ids[j], float(cosines[i, j])) for i, j in itertools.combinations(range(len(ids)), 2) if cosines[i, j] > tau]


@covers("greedy_chains")
def test_greedy_chains(spark, vectors, cosines):
    ids, _, _ = vectors
    chains = [[x] for x in ids]
    for a, b, _ in sorted(edges_above(ids, cosines, 0.3), key=lambda e: (-e[2], -e[0], -e[1])):
        x, y = (next(c for c in chains if n in c) for n in (a, b))
        if len(x) > 1 and len(y) > 1 or x is y:
            continue
        if len(x) == 1 and len(y) == 1:
            x += y
            chains.remove(y)
            continue
        one, many, at = (x, y, b) if len(x) == 1 else (y, x, a)
        if many[-1] == at:
            many += one
        elif many[0] == at:
            many[:0] = one
        else:
            continue
        chains.remove(one)
    assert sorted((r["id"], r["chain"], r["place"]) for r in rows(spark, "greedy_chains")) == sorted((x, min(c), i) for c in chains for i, x in enumerate(c))


def test_greedy_chains_do_not_merge(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.8), (1, 2, 0.7)], "a long, b long, w double")
    got = defaultdict(list)
    for r in graph.greedy_chains(e, graph.components(nodes, e)).orderBy("place").collect():
        got[r["chain"]].append(r["id"])
    assert dict(got) == {0: [0, 1], 2: [2, 3], 4: [4], 5: [5]}


@covers("significance_threshold", "significance_threshold_fdr")
def test_significance_thresholds(spark, vectors, cosines):
    x = np.array([w for _, _, w in edges_above(vectors[0], cosines, -2)])
    p = np.array([1 - NormalDist().cdf((v - x.mean()) / x.std()) for v in x])
    hit = x[p <= 0.05 / len(x)]
    assert tuple(rows(spark, "significance_threshold")[0]) == (pytest.approx(hit.min() if len(hit) else np.percentile(x, 85), abs=1e-6), len(hit))
    order = np.argsort(p, kind="stable")
    below = np.flatnonzero(p[order] <= 0.05 * np.arange(1, len(p) + 1) / len(p))
    hit = x[p <= p[order][below[-1]]] if len(below) else x[:0]
    assert tuple(rows(spark, "significance_threshold_fdr")[0]) == (pytest.approx(hit.min() if len(hit) else np.percentile(x, 85), abs=1e-6), len(hit))


def modularity(part, edges):
    m = sum(w for _, _, w in edges)
    deg = Counter()
    for a, b, w in edges:
        deg[part[a]] += w
        deg[part[b]] += w
    return sum(w for a, b, w in edges if part[a] == part[b]) / m - sum((d / (2 * m)) ** 2 for d in deg.values())


@covers("louvain_communities", "leiden_communities", "label_communities")
def test_communities(spark, vectors, cosines):
    """Louvain beats label propagation and the given labels; Leiden's communities hang together; names are least ids."""
    ids, _, labels = vectors
    edges = edges_above(ids, cosines, 0.25)
    q = {}
    for name in ("louvain_communities", "leiden_communities", "label_communities"):
        part = {r["id"]: r["community"] for r in rows(spark, name)}
        assert sorted(part) == ids
        q[name] = modularity(part, edges)
        if name != "label_communities":
            assert all(c == min(x for x in ids if part[x] == c) for c in set(part.values()))
        if name == "leiden_communities":
            near = defaultdict(set)
            for a, b, _ in edges:
                if part[a] == part[b]:
                    near[a].add(b)
                    near[b].add(a)
            for c in set(part.values()):
                seen, todo = {c}, [c]
                while todo:
                    new = near[todo.pop()] - seen
                    seen |= new
                    todo += new
                assert seen == {x for x in ids if part[x] == c}
    assert min(q["louvain_communities"], q["leiden_communities"]) >= max(q["label_communities"], modularity(dict(zip(ids, labels)), edges)) - 1e-9


def test_louvain_finds_cliques(spark):
    """A ring of eight cliques of five: every clique is a community, alone nodes stay alone."""
    e = [(5 * k + i, 5 * k + j, 1.0) for k in range(8) for i in range(5) for j in range(i)]
    e += [(5 * k, (5 * k + 5) % 40, 1.0) for k in range(8)]
    nodes = spark.createDataFrame([(i,) for i in range(41)], "id long")
    got = {r["id"]: r["community"] for r in graph.louvain(nodes, spark.createDataFrame(e, "a long, b long, w double")).collect()}
    assert got == {**{i: i // 5 * 5 for i in range(40)}, 40: 40}


@covers("betweenness")
def test_betweenness(spark, vectors, cosines):
    ids, _, _ = vectors
    near = defaultdict(dict)
    for a, b, w in edges_above(ids, cosines, 0.4):
        near[a][b] = near[b][a] = w
    dist = {s: {s: 0.0} for s in ids}
    for s in ids:  # Bellman-Ford: other than the engine's search
        while True:
            new = {v: d + w for u, d in list(dist[s].items()) for v, w in near[u].items() if d + w < dist[s].get(v, math.inf) - 1e-12}
            if not new:
                break
            for v, d in new.items():
                dist[s][v] = min(d, dist[s].get(v, math.inf))
    paths = {}
    for s in ids:
        n = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            if v != s:
                n[v] = sum(n[u] for u in near[v] if u in n and abs(dist[s][u] + near[v][u] - dist[s][v]) <= 1e-12)
        paths[s] = n
    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        if t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and v in dist[t] and abs(dist[s][v] + dist[v].get(t, math.inf) - dist[s][t]) <= 1e-12:
                    want[v] += paths[s][v] * paths[v][t] / paths[s][t]
    scale = (len(ids) - 1) * (len(ids) - 2)
    assert {r["id"]: r["betweenness"] for r in rows(spark, "betweenness")} == {i: pytest.approx(x / scale, abs=2e-6) for i, x in want.items()}


def series(spark):
    out = defaultdict(list)
    for r in table(spark, DIR, "events").orderBy("user_id", "ts", "event_id").collect():
        out[r["user_id"]].append(r)
    return out


def ema(xs, span):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] + 2 / (span + 1) * (x - out[-1]))
    return out


@covers("ema_macd")
def test_macd(spark):
    got = {r["event_id"]: r for r in rows(spark, "ema_macd")}
    for events in series(spark).values():
        x = [e["value"] for e in events]
        line = [a - b for a, b in zip(ema(x, 12), ema(x, 26))]
        signal = ema(line, 9)
        last = None
        for e, m, s in zip(events, line, signal):
            r = got[e["event_id"]]
            assert (r["macd"], r["signal"], r["hist"]) == pytest.approx((m, s, m - s), abs=2e-6)
            want = None if last is None else "up" if last <= 0 < m - s else "down" if last >= 0 > m - s else None
            assert r["trigger"] == want or abs(m - s) < 1e-9
            last = m - s


@covers("vector_ema")
def test_vector_ema(spark, vectors):
    ids, m, labels = vectors
    fast, slow, want = {}, {}, {}
    for i, x, g in zip(ids, m, labels):
        fast[g] = 0.618 * fast[g] + 0.382 * x if g in fast else x
        slow[g] = 0.854 * slow[g] + 0.146 * x if g in slow else x
        want[i] = math.sqrt(sum((fast[g] - slow[g]) ** 2))
    assert {r["vec_id"]: r["gap"] for r in rows(spark, "vector_ema")} == {i: pytest.approx(w, abs=2e-6) for i, w in want.items()}


@covers("frequent_sequences")
def test_frequent_sequences(spark):
    """Every pattern of up to three items has its support, and no frequent pair is missing."""
    days = {u: [frozenset(e["event_type"] for e in g) for _, g in itertools.groupby(es, lambda e: e["ts"].date())] for u, es in series(spark).items()}

    def holds(seq, pattern):
        at = 0
        for s in seq:
            at += at < len(pattern) and set(pattern[at]) <= s
        return at == len(pattern)

    got = {tuple(map(tuple, json.loads(r["pattern"]))): r["freq"] for r in rows(spark, "frequent_sequences")}
    assert got and all(n == sum(holds(s, p) for s in days.values()) >= 0.6 * len(days) for p, n in got.items())
    kinds = sorted({k for s in days.values() for d in s for k in d})
    for p in [((a,), (b,)) for a in kinds for b in kinds] + [((a, b),) for a, b in itertools.combinations(kinds, 2)]:
        n = sum(holds(s, p) for s in days.values())
        assert (p in got) == (n >= 0.6 * len(days))


@covers("kmeans_labels", "kmeans_tfidf")
def test_kmeans_is_a_fixed_point(spark, vectors):
    """No vector is nearer to another cluster's mean, but for the tolerance of the last step."""
    ids, m, _ = vectors
    got = {r[0]: r[1] for r in rows(spark, "kmeans_labels")}
    assert sorted(got) == ids and len(set(got.values())) == 5
    lab = np.array([got[i] for i in ids])
    means = np.array([m[lab == k].mean(axis=0) for k in sorted(set(lab))])
    d = ((m[:, None] - means[None]) ** 2).sum(axis=2)
    names = sorted(set(lab))
    assert (np.array([names[k] for k in d.argmin(axis=1)]) == lab).mean() > 0.98


@covers("gaussian_mixture", "explained_variance", "latent_graph", "cell_neighbours", "betweenness_top10", "chain_lengths")
def test_clusters_and_cells(spark, vectors, cosines):
    ids, _, _ = vectors
    got = rows(spark, "gaussian_mixture")
    assert sorted(r["vec_id"] for r in got) == ids and all(0.25 - 1e-6 <= r["confidence"] <= 1 + 1e-6 and r["cluster"] in range(4) for r in got)
    from lodestone.plans.statistics import _tfidf_vectors

    m = np.array([r["vec"] for r in _tfidf_vectors(spark, DIR).collect()])
    eig = np.sort(np.linalg.eigvalsh(np.cov(m.T, bias=True)))[::-1]
    assert rows(spark, "explained_variance")[0]["explained"] == pytest.approx(eig[:16].sum() / eig.sum(), abs=1e-5)
    vec = {r["doc_id"]: np.array(r["vec"]) for r in rows(spark, "latent_projection")}
    want = {(a, b) for a, b in itertools.combinations(sorted(vec), 2) if round(float(vec[a] @ vec[b]), 6) > 0.55}
    assert {(r["a"], r["b"]) for r in rows(spark, "latent_graph")} == want
    near = rows(spark, "cell_neighbours")
    hits = total = 0
    for i in ids:
        if i % 20 == 0:
            best = {j for j in sorted((j for j in ids if j != i), key=lambda j: (-cosines[ids.index(i), ids.index(j)], j))[:10]}
            mine = [r for r in near if r["query_id"] == i]
            assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1)) and all(r["score"] == pytest.approx(cosines[ids.index(i), ids.index(r["doc_id"])], abs=2e-6) for r in mine)
            hits += len(best & {r["doc_id"] for r in mine})
            total += len(best)
    assert total and hits / total >= 0.9
    b = rows(spark, "betweenness")
    assert [tuple(r) for r in rows(spark, "betweenness_top10")] == sorted(map(tuple, b), key=lambda r: (-r[1], r[0]))[:10]
    n = Counter(r["chain"] for r in rows(spark, "greedy_chains"))
    assert [tuple(r) for r in rows(spark, "chain_lengths")] == sorted(n.items(), key=lambda x: (-x[1], x[0]))


@covers("latent_projection")
def test_latent_projection(spark):
    got = [np.array(r["vec"]) for r in rows(spark, "latent_projection")]
    assert all(len(v) == 16 for v in got) and all(abs(np.linalg.norm(v) - 1) < 1e-6 or not v.any() for v in got)
    q = table(spark, DIR, "benchmark").select("item_id", tx.letter_runs(F.col("text")).alias("t")).collect()
    by = {r["item_id"]: Counter(r["t"]) for r in q}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(by), 2) if by[a] == by[b] and by[a]]
    vec = {r["doc_id"]: np.array(r["vec"]) for r in rows(spark, "latent_projection")}
    assert all(np.allclose(vec[a], vec[b], atol=1e-6) for a, b in pairs) and sorted(vec) == sorted(i for i in by if by[i])


@covers("tier_quotas")
def test_tier_quotas(spark):
    d = table(spark, DIR, "documents").select("doc_id", "source").toPandas()
    n = d.groupby("source", dropna=False).size()
    lam = float(sampling.yeo_johnson_lambda(n.to_numpy(dtype=float)))
    y = np.log1p(n) if abs(lam) < 1e-12 else ((n + 1.0) ** lam - 1) / lam
    lo, hi = y.mean() - y.std(ddof=0), y.mean() + y.std(ddof=0)
    quota = {s: 5 if v < lo - 1e-9 else 8 if v <= hi + 1e-9 else 13 for s, v in y.items()}
    got = rows(spark, "tier_quotas")
    assert Counter(r["source"] for r in got) == {s: min(q, int(n[s])) for s, q in quota.items()}
    assert {(r["doc_id"], r["source"]) for r in got} <= set(map(tuple, d.itertuples(index=False))) and len({r["doc_id"] for r in got}) == len(got)


@covers("nominal_upper_bound")
def test_nominal_upper_bound(spark):
    x = np.log1p(table(spark, DIR, "lineitem").select("l_extendedprice").toPandas()["l_extendedprice"].to_numpy())
    med = np.median(x)
    kept = x[np.abs(x - med) <= 3.0 * 1.4826 * np.median(np.abs(x - med))]
    y = np.log1p(kept)
    got = rows(spark, "nominal_upper_bound")[0]
    assert got["upper"] == pytest.approx(np.expm1(np.expm1(y.mean() + 1.959964 * y.std())), rel=1e-6) and got["mean_log"] == pytest.approx(kept.mean(), abs=1e-6)


@covers("sentence_chunks")
def test_sentence_chunks(spark):
    got = Counter()
    for r in rows(spark, "sentence_chunks"):
        got[r["doc_id"]] += 1
    docs = {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").collect()}
    assert set(got) <= set(docs)
    for i, t in docs.items():
        assert got[i] <= len((t or "").split()) // 31 + 1


@covers("normal_cdf")
def test_normal_cdf(spark):
    x = {r["c_custkey"]: r["c_acctbal"] for r in table(spark, DIR, "customer").collect()}
    v = np.array([float(b) for b in x.values()])
    d = NormalDist(v.mean(), v.std())
    assert {r["c_custkey"]: r["p"] for r in rows(spark, "normal_cdf")} == {k: pytest.approx(d.cdf(float(b)), abs=2e-5) for k, b in x.items()}


@covers("mmr_selection")
def test_mmr(spark, vectors, cosines):
    ids, m, _ = vectors
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in rows(spark, "mmr_selection"):
        got[r["query_id"]][r["place"]] = r["doc_id"]
    at = {i: k for k, i in enumerate(ids)}
    for q in ids[::25]:
        pool = sorted((i for i in ids if i != q), key=lambda i: (-cosines[at[q], at[i]], i))[:20]
        chosen = []
        for place in range(1, 6):
            worth = lambda i: 0.7 * cosines[at[q], at[i]] - 0.3 * max((u[at[i]] @ u[at[c]] for c in chosen), default=0)
            best = max((i for i in pool if i not in chosen), key=lambda i: (round(worth(i), 9), -pool.index(i)))
            assert worth(got[q][place]) == pytest.approx(worth(best), abs=1e-8)
            chosen.append(got[q][place])


@covers("mmr_walk", "cluster_routing")
def test_walks_and_routes(spark, vectors, cosines):
    ids, m, labels = vectors
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(ids)}
    ranked = lambda q, pool: sorted((i for i in pool if i != q), key=lambda i: (-cosines[at[q], at[i]], i))

    def select(q, pool, k, lam, trail):
        chosen = []
        while len(chosen) < min(k, len(pool)):
            worth = lambda i: lam * cosines[at[q], at[i]] - (1 - lam) * max((u[at[i]] @ u[at[c]] for c in chosen[-trail:]), default=0)
            chosen.append(max((i for i in pool if i not in chosen), key=lambda i: (round(worth(i), 12), -pool.index(i))))
        return chosen

    walks = defaultdict(dict)
    for r in rows(spark, "mmr_walk"):
        walks[r["query_id"]][r["place"]] = r["doc_id"]
    for q in ids[::50]:
        assert [walks[q][k] for k in range(1, 21)] == select(q, ranked(q, ids)[:50], 20, 0.6, 12)
    means = {g: u_g / np.linalg.norm(u_g) for g in set(labels) for u_g in [m[[k for k, x in enumerate(labels) if x == g]].mean(axis=0)]}
    want = {}
    for q in ids:
        if q % 20:
            continue
        mass = Counter()
        for i in ranked(q, ids)[:10]:
            mass[labels[at[i]]] += max(cosines[at[q], at[i]], 0)
        worth = {g: round(0.7 * float(u[at[q]] @ means[g]) + 0.3 * w, 9) for g, w in mass.items()}
        best = sorted(worth, key=lambda g: (-worth[g], g))[:3]
        positive, rest = sum(max(worth[g], 0) for g in best), 12 - len(best)
        for g in best:
            budget = max(1, 1 + round(max(worth[g], 0) / positive * rest)) if positive > 0 and rest > 0 else 1
            pool = ranked(q, [i for i in ids if labels[at[i]] == g])[:20]
            want.update({(q, i): g for i in select(q, pool, budget, 0.7, 99)})
        for i in ranked(q, ids)[:3]:
            want.setdefault((q, i), None)
    assert {(r["query_id"], r["doc_id"]): r["cluster"] for r in rows(spark, "cluster_routing")} == want


@covers("correlation_sort")
def test_correlation_sort(spark, vectors):
    ids, m, labels = vectors
    got = defaultdict(list)
    for r in sorted(rows(spark, "correlation_sort"), key=lambda r: r["place"]):
        got[r["label"]].append(r["vec_id"])
    for g, order in got.items():
        own = [i for i, x in zip(ids, labels) if x == g]
        assert sorted(order) == own
        c = dict(zip(own, range(len(own))))
        r = np.nan_to_num(np.corrcoef(np.array([m[ids.index(i)] for i in own])))
        for k in range(1, min(6, len(order))):
            mean = lambda i: r[c[i], [c[x] for x in order[:k]]].mean()  # noqa: E731,B023
            assert mean(order[k]) == pytest.approx(min(mean(i) for i in order[k:]), abs=1e-9)


@covers("anchor_pack")
def test_anchor_pack(spark):
    got = rows(spark, "anchor_pack")
    assert got and len({tuple(r) for r in got}) == len(got)


def test_boilerplate_cases(spark):
    d = spark.createDataFrame([("- **a** prose in between **b**",), ("x\n-**Bold**\ny",), ("x\n- **Bold**:\ny",), ("--- a --- b",), ("|a|b| \nz",)], "t string")
    assert [r[0] for r in d.select(tx.strip_boilerplate(F.col("t"))).collect()] == ["- **a** prose in between **b**", "x\n\ny", "x\n- **Bold**:\ny", "b", "|a|b| \nz"]
    p = spark.createDataFrame([("[[A b]] [x](y) `c`",), ("[[]] [x]() ``",)], "t string")
    assert [r[0] for r in p.select(tx.normalize_phrase(F.col("t"))).collect()] == ["a b x c", "[[]] [x]() ``"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([(i, f"v{i}") for i in range(7)], "i int, v string")
    out = sinks.markdown_table(d.orderBy("i"), limit=5).splitlines()
    assert len(out) == 9 and out[-1] == "2 more rows" and len(sinks.markdown_table(d, 7).splitlines()) == 9
    nested = sinks.nested_report(d.withColumn("g", F.col("i") % 2), ["g"]).orderBy("g").collect()
    assert json.loads(nested[1]["json"]) == {"g": 1, "rows": [{"i": i, "v": f"v{i}"} for i in (1, 3, 5)]}
    at = str(tmp_path / "t")
    for n in (3, 5):
        sinks.write_snapshot(d.limit(n), at)
        assert spark.read.parquet(at).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_helpers(spark):
    lua = spark.createDataFrame([("a.lua", "local M = {}\nlocal function one(x)\n  local function inner() end\nfunction M.two()\nlocal j = require('cjson')\nrequire \"net.http\"\n"), ("b.lua", "")], "path string, content string")
    got = {r["path"]: (r["functions"], r["requires"]) for r in files.lua_symbols(lua).collect()}
    assert got["a.lua"] == (["M.two", "one"], ["cjson", "net.http"]) and got["b.lua"] == ([], [])
    assert latent.collinearity_verdict(0.8) == "redundant" and latent.collinearity_verdict(0.2) == "complementary" and latent.collinearity_verdict(0.5) == "partial"
    assert latent.correlation_p_value(0.5, 30) == pytest.approx(math.erfc(math.atanh(0.5) * math.sqrt(27) / math.sqrt(2))) and latent.correlation_p_value(1.0, 9) == 0.0
    claims = spark.createDataFrame([(20, 0), (20, 1), (5, 0)], "age int, visit_count int")
    assert [tuple(r) for r in selection.stale_claims(claims, "age", 10).collect()] == [(20, 0)]
    v = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "b", 1.0)], "doc_id long, term string, weight double")
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.sparse_cosine(v, v.withColumnRenamed("doc_id", "query_id")).collect()} == {(1, 1): 1.0, (1, 2): 0.8, (2, 1): 0.8, (2, 2): 1.0}
