"""Faults that only show on larger tables or odd rows, each at the smallest size that shows it."""

import hashlib
import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import centrality, chunking, evaluate, graph, links, search, vectors, verify
from annalist.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.test_operators import commit, commits, value


def test_long_numbers_are_no_shas(spark):
    said = "See PR #1000001, issue 1000002 and abc1234f."
    assert list(value(spark, evaluate.cited_entities(F.col("t")), t=said)) == ["abc1234f", "issue#1000002", "pr#1000001"]
    m = value(spark, evaluate.citation_metrics(F.col("t"), F.array(F.lit("pr#1000001"), F.lit("abc1234f"))), t=said)
    assert (round(m.precision, 6), m.recall) == (round(2 / 3, 6), 1.0)
    assert list(value(spark, evaluate.cited_entities(F.col("t")), t="in 1234567 and PR 7")) == ["1234567", "pr#7"]


def _history(spark, *shas):
    """Commits, and a pull that merges the first of them."""
    pull = spark.createDataFrame([("r", 9, "t", "", "merged", "A", shas[0], [], [])], "repo_id string, number int, title string, body string, state string, author string, merge_commit_sha string, linked_issue_numbers array<int>, linked_commit_shas array<string>")
    issue = spark.createDataFrame([], "repo_id string, number int, title string, body string, linked_pr_numbers array<int>, linked_commit_shas array<string>")
    return commits(spark, *(commit(s, message=f"m {s}") for s in shas)), pull, issue


def test_links_lead_to_the_commit_meant_of_two_with_equal_first_characters(spark):
    one, two = "abcdef1" + "0" * 33, "abcdef1" + "1" * 33
    c, p, i = _history(spark, one, two)
    hits = spark.createDataFrame([("h", 0.05, ["pr:#9"])], "id string, score double, refs array<string>")
    chunks = chunking.chunk_commits(c)
    meant = chunks.where(F.col("source_id") == one).first().id
    found = graph.follow_links(links.materialise_edges(c, p, i, whole_shas=True), hits, chunks).collect()
    assert [(r.id, r.via) for r in found] == [(meant, "commit:abcdef1")]
    short = graph.follow_links(links.materialise_edges(c, p, i), hits, chunks).collect()
    assert {r.via for r in short} == {"commit:abcdef1"} and meant in {r.id for r in short}


def test_a_long_number_is_looked_up_as_a_number(spark):
    c, p, i = _history(spark, "1000020" + "a" * 33, "7654321" + "b" * 33)
    p = p.withColumn("number", F.lit(1000020))
    chunks = spark.createDataFrame([], "repo_id string, source_type string, source_id string, related_ids array<string>")
    refs = spark.createDataFrame([("1000020",), ("7654321",), ("1000021",)], "ref string")
    found = {(r.ref, r.kind, r.key) for r in links.related_discussion(refs, c, p, i, chunks).collect()}
    assert found == {("1000020", "pr", "1000020"), ("7654321", "commit", "7654321" + "b" * 33)}


def test_a_long_number_is_no_sha_in_forensics(spark):
    c, p, i = _history(spark, "1000020" + "a" * 33, "7654321" + "b" * 33)
    p = p.withColumn("number", F.lit(1000020))
    texts = spark.createDataFrame([("q", "why #1000020 or #1000021 or #1000022 and 7654321b?")], "text_id string, text string")
    symbols = spark.createDataFrame([], "repo_id string, symbol_id string, file_path string, symbol_name string, kind string")
    found = {r.evidence for r in links.candidate_forensics(texts, p, i, c, symbols).collect()}
    assert found == {"Pull Request #1000020: t", "Commit 7654321: m 7654321" + "b" * 33}


def test_exact_channel_query_over_texts_that_name_the_number_or_the_sha(spark, tmp_path):
    abc = next(i for i in range(10, 10**6, 12) if "abc" in hashlib.md5(str(i).encode()).hexdigest())
    rows = [(3, "pr 7"), (7, "issue 7"), (9, "xABCx"), (abc, "an abc"), (4, None), (22, None), (11, "pr 7 #7")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.id for r in QUERIES["r11_exact_channel"](spark, str(tmp_path)).collect()}
    assert found == {str(abc), "4"} | ({"22"} if "abc" in hashlib.md5(b"22").hexdigest() else set())


def test_vector_table_rounds_as_floats(spark, tmp_path):
    """0.25605 as a float is a little less; by 10,000 and a half it is 2,561 in floats and under that in doubles."""
    x = next(float(v) for v in (np.float32(i / 100_000) for i in range(5, 100_000, 10)) if math.floor(v * np.float32(10_000) + np.float32(0.5)) != math.floor(float(v) * 10_000 + 0.5))
    spark.createDataFrame([(2, [x, 0.0]), (4, [0.5, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(ORACLE_SQL["r7_r8_vector_table"].split("cf AS")[0].split("WITH")[0] + "SELECT" + ORACLE_SQL["r7_r8_vector_table"].rsplit("SELECT", 1)[1].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["r7_r8_vector_table"](spark, str(tmp_path)).collect())) == sorted(want)


def test_texts_are_cut_into_tokens_once(spark):
    rows = [("a", "The the fooBar Öl ÖL HTTPServer x_1 The"), ("b", ""), ("c", None), ("d", "b a b")]
    found = search.postings_of(spark.createDataFrame(rows, "id string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = {(r.id, r.len, r.term, r.tf) for r in found.collect()}
    assert {g for g in got if g[0] == "d"} == {("d", 3, "a", 1), ("d", 3, "b", 2)}
    assert {(g[2], g[3]) for g in got if g[0] == "a"} == {("the", 3), ("foobar", 1), ("foo", 1), ("bar", 1), ("öl", 2), ("httpserver", 1), ("http", 1), ("server", 1), ("x_1", 1), ("x", 1), ("1", 1)}
    assert {g[0] for g in got} == {"a", "d"}


def test_queries_are_sanitised_once(spark):
    said = spark.createDataFrame([("why RePo:x gIt  LOG is:y --STAT=1 -- 'z'",), ("is:a",), (None,), ("xrepo:y this:z git-log -stat",)], "q string").select(T.sanitize_query(F.col("q")).alias("q"))
    assert said._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 4
    assert [r.q for r in said.collect()] == ["why z", "is:a", None, "xrepo:y this:z git-log -stat"]


def test_betweenness_takes_off_the_ends_of_trees_first(spark, monkeypatch):
    """Trees need no search; a graph with a cycle, parallel ways and trees hung on it the values of a search from every node."""
    tree = [(f"n{(i - 1) // 3}", f"n{i}") for i in range(1, 14)]
    knot = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e"), ("d", "e"), ("e", "n0"), ("x", "a"), ("b", "p"), ("p", "q"), ("q", "r"), ("q", "s"), ("e", "e"), ("e", None)]
    edges = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string")
    by_node = lambda df: {r.node: round(r.betweenness, 12) for r in df.collect()}
    assert by_node(centrality.betweenness(edges(tree + knot))) == by_node(graph.betweenness(edges(tree + knot)))
    with monkeypatch.context() as m:
        m.setattr(centrality, "_dependencies", None)
        assert by_node(centrality.betweenness(edges(tree))) == by_node(graph.betweenness(edges(tree)))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_ends_that_are_no_nodes_are_looked_up(spark, monkeypatch):
    asked, alias = [], links.symbol_alias
    monkeypatch.setattr(graph.links, "symbol_alias", lambda refs, symbols: asked.extend(r.ref for r in refs.collect()) or alias(refs, symbols))
    rows = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    symbols = spark.createDataFrame([("r", "a.py::f", "f")], "repo_id string, symbol_id string, symbol_name string")
    found = graph.canonical_nodes(rows("node", "pr:#9", "#9", "f", "symbol:a.py::f", "none", None), rows("id", "pr:#9", "symbol:a.py::f"), symbols)
    assert {(r.node, r.canonical) for r in found.collect()} == {("pr:#9", "pr:#9"), ("#9", "pr:#9"), ("f", "symbol:a.py::f"), ("symbol:a.py::f", "symbol:a.py::f")}
    assert sorted(asked) == ["#9", "f", "none"]


def test_edges_of_the_graph_are_made_once(spark):
    c, p, i = _history(spark, "abcdef1" + "0" * 33, "abcdef2" + "1" * 33)
    symbols = spark.createDataFrame([], "repo_id string, symbol_id string, symbol_name string")
    nodes, edges = graph.knowledge_graph(c, p, i, symbols, links.materialise_edges(c, p, i), limit=0)
    assert "symbols_modified" not in _plan(edges) and "message" not in _plan(edges)
    assert [(r.source_id, r.target_id) for r in edges.collect()] == [("pr:#9", "commit:abcdef1")]
    assert {r.id for r in nodes.collect()} == {"pr:#9", "commit:abcdef1"}


def test_ranks_of_like_nodes_are_iterated_as_one_row(spark, monkeypatch):
    rows, saved = [("a", "b"), ("b", "a"), ("a", "m"), ("b", "m"), ("b", "m"), ("a", "twice"), ("a", "twice")] + [("a", f"leaf{i}") for i in range(30)], []
    monkeypatch.setattr(graph, "_saved", lambda df, of=graph._saved: saved.append(of(df)) or saved[-1])
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, "source_id string, target_id string"), iterations=6, tolerance=0.0).collect()}
    nodes = sorted({x for r in rows for x in r})
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(6):
        sent = {v: sum(want[a] / sum(r[0] == a for r in rows) for a, b in rows if b == v) for v in nodes}
        lost = sum(want[v] for v in nodes if all(a != v for a, _ in rows))
        want = {v: 0.15 / len(nodes) + 0.85 * (sent[v] + lost / len(nodes)) for v in nodes}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in nodes)
    assert saved[-1].count() == 5  # a, b, m, twice and the leaves


def test_numbers_are_dealt_with_a_hash(spark):
    c, p, i = _history(spark, "abcdef1" + "0" * 33)
    refs = spark.createDataFrame([("9",), (" 9 ",), ("8",), ("none",), ("",), (None,)], "ref string")
    found = links.known_numbers(refs, p, i)
    assert "xxhash64" in _plan(found) and sorted(r.ref for r in found.collect()) == [" 9 ", "9"]


def test_owners_are_looked_for_only_if_something_is_wrong(spark):
    c, p, i = _history(spark, "abcdef1" + "0" * 33)
    evidence = verify.evidence_index(c, chunking.chunk_commits(c))
    drafts = spark.createDataFrame([("d", "Commit abcdef1 stands; see #9 and #8.")], "draft_id string, draft string")
    errors = verify.claim_errors(drafts, evidence, p, i, c)
    assert "misattribution" not in _plan(errors) and [r.message for r in errors.collect()] == ["unknown reference #8"]


def test_what_reverts_is_joined_with_commits_twice(spark):
    one, two, three = ("abcdef" + str(k) * 34 for k in (1, 2, 3))
    c = commits(spark, commit(one, message="First"), commit(two, message=f'Revert "First"\n\nThis reverts commit {one}.'), commit(three, message='Revert "None such"'))
    found = links.resolve_reverts(c)
    assert _plan(found).count("Join ") == 2
    assert {(r.sha, r.reverts_sha, r.how) for r in found.collect()} == {(two, one, "sha"), (three, None, None)}


def test_parsers_run_on_arrow_batches(spark):
    assert "MapInArrow" in _plan(QUERIES["f4_f5_diff_and_symbols"](spark, DATA))


def test_followed_links_neither_shuffle_nor_write_the_edges(spark, monkeypatch):
    near = [("pr:#1", "commit:aaaaaaa"), ("commit:aaaaaaa", "symbol:s"), ("issue:#5", "pr:#1")]
    rows = [(a, b, "t", "L") for a, b in near] + [(f"commit:{i:07x}", f"symbol:{i % 9}", "t", "L") for i in range(500)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, label string")
    chunks = spark.createDataFrame([("c", "commit", "aaaaaaa" + "1" * 33), ("i", "issue", "5"), ("x", "issue", "6")], "id string, source_type string, source_id string")
    hits, made = spark.createDataFrame([("h", 0.05, ["pr:#1"])], "id string, score double, refs array<string>"), []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "written", lambda df, name, of=graph.written: made.append((of(df, name), plan(df))) or made[-1][0])
    found = graph.follow_links(edges, hits, chunks)
    assert {(r.id, r.score, r.via) for r in found.collect()} == {("c", 0.04232, "commit:aaaaaaa"), ("i", 0.04232, "issue:#5")}
    assert max(df.count() for df, _ in made) < 9  # as many as are reached, of 503 edges
    plans = [p for _, p in made] + [plan(found)]
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)


def test_walks_over_parallel_edges(spark):
    rng = random.Random(5)
    node = lambda: f"n{rng.randint(0, 11)}"
    rows = [(node(), node(), rng.choice("st"), rng.choice("KL")) for _ in range(40)]
    edges = spark.createDataFrame([*rows, *rows[:9], ("n1", None, "t", "L"), (None, "n2", "t", "L")], "source_id string, target_id string, edge_type string, label string")
    seeds, want = ["n0", "n3", "none"], {}
    for way, arrow in enumerate((" -> ", " <- ")):
        for seed in seeds:
            front, met = {seed: seed}, set()
            for depth in (1, 2, 3):
                reached = {}
                for a, b, kind, label in rows:
                    a, b = (b, a) if way else (a, b)
                    if a in front and b not in met:
                        best = (f"{front[a]}{arrow}{b}", kind, label)
                        reached[b] = min(best, reached.get(b, best))
                for b, best in reached.items():
                    want[way, seed, b] = (depth, way, *best)
                met |= reached.keys()
                front = {b: best[0] for b, best in reached.items()}
    asked = spark.createDataFrame([(s,) for s in [*seeds, *seeds]], "seed string")
    for direction, ways, compat in (("outgoing", (0,), False), ("incoming", (1,), False), ("both", (0, 1), False), ("incoming", (0, 1), True)):
        got = {(r.seed, r.node): (r.depth, ["outgoing", "incoming"].index(r.direction), r.path, r.edge_type, r.label) for r in graph.traverse(edges, asked, 3, direction, compat).collect()}
        best = {}
        for (way, seed, b), w in want.items():
            if way in ways:
                best[seed, b] = min(w, best.get((seed, b), w))
        assert got == best


def test_edge_rows_lead_where_their_edges_lead(spark):
    one, two = "abcdef1" + "0" * 33, "bbcdef1" + "1" * 33
    _, p, i = _history(spark, one)
    c = commits(spark, commit(one, symbols=["s", "s"]), commit(two, symbols=["s"], reverts_sha=one))
    walk = lambda e: {tuple(r) for r in graph.traverse(e, spark.createDataFrame([("pr:#9",), ("symbol:s",)], "seed string"), 3).collect()}
    assert walk(links.edge_rows(c, p, i, True)) == walk(links.materialise_edges(c, p, i, True)) != set()
