"""Ranks and sums over ranges, centrality by levels, and the approximate vector index, against brute force."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import ann, centrality, graph, links, ranks, search


def test_ranks_and_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 5), rng.choice([None, 3, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, s int, n int").repartition(7)
    want = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    order = [F.desc("s"), F.asc("id")]
    assert {r.id: r["rank"] for r in ranks.global_rank(df, order).collect()} == want
    groups = {g: [r for r in rows if r[1] == g] for g in ("a", "b", None)}
    want = {r[0]: p for g in groups.values() for p, r in enumerate(sorted(g, key=lambda r: (-r[2], r[0])), 1)}
    assert {r.id: r["rank"] for r in ranks.group_rank(df, "g", order).collect()} == want
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: r[0]):
        total += r[3] or 0
        want[r[0]] = total
    assert {r.id: r["sum"] for r in ranks.running_sum(df, [F.asc("id")], "n").collect()} == want
    for f in (lambda d: ranks.global_rank(d, order), lambda d: ranks.group_rank(d, "g", order), lambda d: ranks.running_sum(d, order, "n")):
        assert f(df.limit(0)).count() == 0


def test_no_window_without_a_partition(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("sub_question_idx"), F.rand(1).alias("score"))
    lines = df.select(F.col("id").alias("pos"), F.lit("x").alias("line"))
    for made in (search.interleave(df), search.within_budget(lines, 100), ranks.running_sum(lines.withColumn("n", F.lit(1)), [F.asc("pos")], "n")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def naive_betweenness(pairs, sources=None):
    nodes = sorted({x for p in pairs for x in p})
    after = {v: sorted({w for a, w in pairs if a == v and w != v}) for v in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes if sources is None else sources:
        far, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
        depends = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in after[v] and far[w] == far[v] + 1:
                    depends[v] += paths[v] / paths[w] * (1 + depends[w])
            if w != s:
                total[w] += depends[w]
    n = len(nodes)
    return {v: t * (1 / ((n - 1) * (n - 2)) if n > 2 else 1) for v, t in total.items()}


def test_centrality_by_levels(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(f"n{rng.randint(0, 24)}", f"n{rng.randint(0, 24)}") for _ in range(60)]
    edges = spark.createDataFrame([*pairs, *pairs[:5], ("n1", None), (None, "n2")], "source_id string, target_id string")
    want = naive_betweenness(pairs)
    close = lambda got: {r.node for r in got} == set(want) and all(abs(r.betweenness - want[r.node]) < 1e-12 for r in got)
    assert close(centrality.betweenness(edges, batch=9).collect())
    assert close(graph.betweenness(edges).collect()) and close(graph.betweenness(edges, max_edges=10).collect())
    assert centrality.betweenness(edges.limit(0)).count() == 0
    some = centrality.betweenness(edges, pivots=15).collect()
    assert all(abs(r.betweenness - want[r.node]) <= r.error for r in some) and 0 < some[0].error < 1


def test_a_walk_stops_at_what_it_has_met(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r0", "r2")]
    edges = spark.createDataFrame([(a, b, "t", "L") for a, b in ring], "source_id string, target_id string, edge_type string, label string")
    seeds = spark.createDataFrame([("r0",)], "seed string")
    got = {r.node: (r.depth, r.path) for r in graph.traverse(edges, seeds, 50, "outgoing").collect()}
    assert got == {"r1": (1, "r0 -> r1"), "r2": (1, "r0 -> r2"), "r3": (2, "r0 -> r2 -> r3"), "r4": (3, "r0 -> r2 -> r3 -> r4"), "r0": (4, "r0 -> r2 -> r3 -> r4 -> r0")}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    odd = [(9001, [0.0] * 32), (9002, None), (9003, [1.0]), (9004, [float("nan")] * 32)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).cache()


def recall(got, exact):
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.id)
    return np.mean([len(by.get(q, set()) & ids) / len(ids) for q, ids in exact.items() if ids])


def exact_hits(rows, queries, allowed, k=10):
    ids = np.array([i for i, _ in rows if allowed(i)])
    x = np.array([v for i, v in rows if allowed(i)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {q: set(ids[np.argsort(-(x @ np.array(v)) / np.linalg.norm(v), kind="stable")[:k]].tolist()) for q, v in queries}


def test_recall_of_the_vector_index(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    monkeypatch.setattr(ann, "QUERIES", 60)
    model, codes = ann.build(vectors, str(tmp_path / "index"), lists=32, parts=8)
    rows = [(r.id, list(r.embedding)) for r in vectors.where("id < 9000").collect()]
    assert codes.count() == len(rows)
    asked = vectors.where("id % 20 = 0 and id < 9000").select(F.col("id").alias("query_id"), "embedding")
    asked = asked.unionByName(spark.createDataFrame([(-1, [0.0] * 32), (-2, [1.0]), (-3, None)], "query_id long, embedding array<float>"))
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    got = ann.search(model, codes, vectors, asked, probes=8).collect()
    assert recall(got, exact_hits(rows, queries, lambda i: True)) >= 0.9 and {r.query_id for r in got} == {i for i, _ in queries}
    wide = vectors.where("id % 3 = 0")
    got = ann.search(model, codes, vectors, asked, probes=8, allowed=wide).collect()
    assert recall(got, exact_hits(rows, queries, lambda i: i % 3 == 0)) >= 0.9 and all(r.id % 3 == 0 for r in got)
    few = vectors.where("id in (5, 17, 230)")
    got = ann.search(model, codes, vectors, asked, probes=1, allowed=few).collect()
    assert len(got) == 3 * len(queries)  # a narrow filter loses nothing
    again = ann.load(spark, str(tmp_path / "index"))
    assert np.allclose(again[0].centres, model.centres) and np.allclose(again[0].words, model.words)
    best = {r.id: r.score for r in ann.search(*again, vectors, asked.where("query_id = 0"), probes=32).collect()}
    same = {r.id: r.score for r in search.vector_search(vectors.where("id < 9000"), dict(queries)[0]).collect()}
    assert len(set(best) & set(same)) >= 9 and all(abs(best[i] - same[i]) < 1e-9 for i in set(best) & set(same))


# --- switches of size at lowered values -----------------------------------------------------------------------------------


def test_words_that_are_not_pushed(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"alpha beta{i % 3} gamma{i % 7}") for i in range(40)], "id string, text string")
    asked = spark.createDataFrame([(0, "alpha beta1"), (1, "gamma2 gamma3 beta0")], "query_id int, query string")
    fitted = search.bm25_fit(docs)
    found = lambda: {(r.query_id, r.id, round(r.score, 9)) for r in search.bm25_search(fitted, asked).collect()}
    want = found()
    monkeypatch.setattr(search, "PUSHED_WORDS", 1)
    assert want and found() == want


def test_words_that_are_not_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "does Login call handle_token or logins"), (2, "nothing"), (3, None)], "text_id int, text string")
    symbols = spark.createDataFrame([(f"src/{n}.py::{n}", n, f"src/{n}.py", "function", "r") for n in ("login", "handle_token", "tea", "loginsPage")], "symbol_id string, symbol_name string, file_path string, kind string, repo_id string")
    found = lambda: sorted((r.text_id, r.symbol_id) for r in links.candidate_symbols(texts, symbols).collect())
    want = found()
    monkeypatch.setattr(links, "WORDS_MOST", 1)
    assert len(want) >= 3 and found() == want
