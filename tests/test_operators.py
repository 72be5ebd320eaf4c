import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from annalist.functions import code, text as T
from annalist.operators import analytics, chunking, evaluate, graph, links, merge, search, verify
from annalist.schemas import SCHEMAS, empty
from annalist.plans.queries import QUERIES
from annalist.sources import fixtures, history
from tests.conftest import DATA


def value(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items()), F.lit(1).alias("_")).select(column.alias("v")).first().v


def commit(sha, files=(), author="A", email="a@x.org", day=1, message="m", symbols=(), repo="r", **more):
    row = dict.fromkeys([f.split()[0] for f in SCHEMAS["commit"].split(", ")])
    return tuple((row | {"repo_id": repo, "sha": sha, "author_name": author, "author_email": email, "authored_date": datetime(2024, 1, day), "message": message, "files_changed": list(files), "symbols_modified": list(symbols), "is_revert": False} | more).values())


def commits(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["commit"])


def test_refs(spark):
    r = value(spark, T.extract_refs(F.col("t")), t="Fixes #123, closes #456, see github.com/a/b/pull/789 and abc1234")
    assert (r.closes, r.mentions, r.shas) == ([123, 456], [789], ["abc1234"])


@pytest.mark.parametrize(("message", "subject"), [('Revert "Don\'t crash"', "Don't crash"), ('Revert "Revert "x""', 'Revert "x"'), ("plain", None)])
def test_revert_subject(spark, message, subject):
    assert value(spark, T.reverted_subject(F.col("t")), t=message) == subject


def test_uuid5(spark):
    assert value(spark, T.uuid5_url(F.col("t")), t="r:commit:é:0") == str(uuid.uuid5(uuid.NAMESPACE_URL, "r:commit:é:0"))


@pytest.mark.parametrize(("path", "want"), [("a/{old => new}/b.py", "a/new/b.py"), ("a/{ => new}/b.py", "a/new/b.py"), ("a/{old => }/b.py", "a/b.py"), ("old.py => new.py", "new.py"), ('"/q r.py"', "q r.py")])
def test_rename(spark, path, want):
    assert value(spark, T.rename_target(F.col("t")), t=path) == want


def test_tokens(spark):
    got = value(spark, T.code_tokens(F.col("t")), t="getUserName snake_case café HTTPServer")
    assert {"getusername", "get", "user", "name", "snake_case", "snake", "case", "café", "httpserver", "http", "server"} <= set(got)


def test_parse_log(spark):
    record = "abc\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00+01:00\x1fp1 p2\x1fSubject\nbody\x1fNUMSTAT\n10\t5\ta.py\n2\t0\tb.py\n-\t-\ti.png\n"
    r = history.parse_commits(spark.createDataFrame([(record,), ("bad",)], "record string"), "r").collect()
    assert len(r) == 1 and (r[0].insertions, r[0].deletions, r[0].files_changed, r[0].is_merge) == (12, 5, ["a.py", "b.py", "i.png"], True)


def test_coupling_skips_large_commits(spark):
    df = commits(spark, commit("1", [f"f{i}" for i in range(30)]), commit("2", [f"f{i}" for i in range(30)]))
    assert analytics.change_coupling(df).count() == 0


def test_ownership_identities(spark):
    same_email = commits(spark, commit("1", author="Ann"), commit("2", author="Ann B", day=2))
    assert [(r.commit_count, r.percentage, r.bus_factor_risk) for r in analytics.ownership(same_email).collect()] == [(2, 100.0, "HIGH")]
    same_name = commits(spark, commit("1"), commit("2", email="b@x.org"))
    assert [(r.email, r.commit_count) for r in analytics.ownership(same_name).collect()] == [("a@x.org", 2)]
    assert analytics.ownership(empty(spark, "commit")).count() == 0


def test_symbol_history(spark):
    df = commits(spark, commit("1", symbols=["auth.py::login"]), commit("2", symbols=["auth.py::login_helper"]))
    assert analytics.symbol_history(df, "LOGIN").count() == 1 and analytics.symbol_history(df, "login", fuzzy=True).count() == 2


def test_reverts_as_of(spark):
    df = commits(spark, commit("a" * 40, message="Add x"), commit("b" * 40, message="Add x", day=3), commit("c" * 40, message='Revert "Add x"', day=2), commit("d" * 40, message="undo\n\nThis reverts commit " + "b" * 10, day=4))
    got = {r.sha[0]: (r.reverts_sha[0], r.how) for r in links.resolve_reverts(df).collect()}
    assert got == {"c": ("a", "subject"), "d": ("b", "sha")}


def test_innermost_symbol(spark):
    s = spark.createDataFrame([("f", "A", 1, 9), ("f", "A::m", 3, 5), ("f", "B", 10, None)], "file string, symbol_id string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", n) for n in (2, 4, 12, 99)], "file string, line_no int")
    assert {r.line_no: r.symbol_id for r in links.lines_to_symbols(lines, s, ["file"]).collect()} == {2: "A", 4: "A::m", 12: "B"}


EDGES = "repo_id string, source_id string, target_id string, edge_type string, label string, highlight boolean"


def edges(spark, *pairs):
    return spark.createDataFrame([("", a, b, "t", "T", False) for a, b in pairs], EDGES)


def test_traverse(spark):
    e = edges(spark, ("issue:#101", "pr:#501"), ("pr:#501", "commit:a1b2c3d"), ("commit:a1b2c3d", "symbol:v"), ("symbol:v", "issue:#101"))
    seeds = spark.createDataFrame([("issue:#101",)], "seed string")
    got = {r.node: r.depth for r in graph.traverse(e, seeds, 3, "outgoing").collect()}
    assert got == {"pr:#501": 1, "commit:a1b2c3d": 2, "symbol:v": 3}
    assert {r.node for r in graph.traverse(e, seeds, 1, "incoming").collect()} == {"symbol:v"}
    assert graph.seed_variants("101") == ["101", "issue:#101", "pr:#101", "#101"]


def test_pagerank_and_betweenness(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    ranks = {r.node: r.rank for r in graph.pagerank(e).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["b"] > ranks["a"]
    line = edges(spark, ("a", "b"), ("b", "c"))
    assert {r.node: r.betweenness for r in graph.betweenness(line).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert graph.topology(edges(spark, ("a", "b")).limit(0))["total_nodes"] == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_betweenness_query_by_counting_paths(spark):
    """g4b against distances and numbers of shortest paths between all pairs of its graph."""
    pairs = {(r.source_id, r.target_id) for r in fixtures.place_edges(spark, DATA, True).collect()}
    nodes = sorted({x for p in pairs for x in p})
    after = {v: [t for s, t in pairs if s == v] for v in nodes}
    far, paths = {}, {}
    for s in nodes:
        far[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            step = {}
            for v in front:
                for w in after[v]:
                    if w not in far[s]:
                        step[w] = step.get(w, 0) + paths[s][v]
            far[s] |= dict.fromkeys(step, far[s][front[0]] + 1)
            paths[s] |= step
            front = list(step)
    n = len(nodes)
    want = {}
    for v in nodes:
        through = [paths[s][v] * paths[v][t] / paths[s][t] for s in nodes for t in far[s] if v in far[s] and v not in (s, t) and t != s and t in far[v] and far[s][v] + far[v][t] == far[s][t]]
        want[v] = pytest.approx(sum(through) / ((n - 1) * (n - 2)), abs=1e-6)
    assert {r.node: r.betweenness for r in QUERIES["g4b_betweenness"](spark, DATA).collect()} == want
    assert graph.betweenness(edges(spark, ("a", "b")).limit(0)).count() == 0


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "x", "me"), (2, "y", "me")], "k int, v string, author string")
    new = spark.createDataFrame([(1, None, "you"), (3, "z", "you")], "k int, v string, author string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ("author",)).collect())) == [(1, "x", "me"), (2, "y", "me"), (3, "z", "you")]


def test_bm25_common_term_has_floor(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a d")], "id string, text string")
    q = spark.createDataFrame([(0, "a")], "query_id int, query string")
    got = search.bm25_search(search.bm25_fit(docs), q).collect()
    assert len(got) == 3 and all(r.score > 0 for r in got)


def test_commit_chunks_by_bullet(spark):
    c = commits(spark, commit("1" * 40, message="Squash\n\n* first change\n* second change\n* third change"))
    assert chunking.chunk_commits(c).count() == 4
    c = commits(spark, commit("1" * 40, message="Squash\n\n* one of 2\n- two of 3\n  • three (#5)\nend"))
    assert [r.text for r in chunking.chunk_commits(c).collect()][1:] == ["Commit 1111111: * one of 2", "Commit 1111111: - two of 3", "Commit 1111111: • three (#5)"]


def test_diff_and_symbols():
    diff = "--- a/s/auth.py\n+++ b/s/auth.py\n@@ -10,2 +10,3 @@\n x\n+new\n y\n--- a/d.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    assert code.diff_lines(diff) == [("s/auth.py", "added", 11), ("d.py", "deleted", 1)]
    got = code.symbols_of("class A:\n    def m(self):\n        pass\n", "a.py")
    assert [s[0] for s in got] == ["a.py::A", "a.py::A::m"]
    js = code.symbols_of("class A {\n  run() {}\n}\nfunction f() {\n}\n", "a.js")
    assert [(s[0], s[3], s[4]) for s in js] == [("a.js::A", 1, 3), ("a.js::A::run", 2, 2), ("a.js::f", 4, 5)]
    assert code.code_chunks("def f():\n    return 1\n", "a.py") == [("a.py::f", "def f():\n    return 1")]


def test_citation_metrics(spark):
    m = value(spark, evaluate.citation_metrics(F.col("t"), F.array(F.lit("abc1234f"), F.lit("pr#12"))), t="see abc1234f and #12 and #99")
    assert (m.precision, m.recall) == (1.0, 0.5)  # a bare #12 is neither a pull nor an issue
    m = value(spark, evaluate.citation_metrics(F.col("t"), F.array(F.lit("abc1234f"), F.lit("pr#12"))), t="see abc1234f, PR 12 and issue #99")
    assert (round(m.precision, 3), m.recall) == (0.667, 1.0)


def test_claims(spark):
    c = commits(spark, commit("a1" * 20, ["src/auth.py"]), commit("b2" * 20, ["src/db.py"], day=2, reverts_sha="a1" * 20))
    ev = verify.evidence_index(c, empty(spark, "chunk"))
    drafts = spark.createDataFrame([(1, "Commit b2b2b2b reverts commit a1a1a1a."), (2, "a1a1a1a reverted b2b2b2b."), (3, "b2b2b2b preceded a1a1a1a."), (4, "Commit a1a1a1a changed db.py here."), (5, "See #77 and the added facade.")], "draft_id int, draft string")
    errors = verify.claim_errors(drafts, ev, empty(spark, "pull_request"), empty(spark, "issue"), c)
    assert {(r.draft_id, r.rule) for r in errors.collect()} == {(2, "revert inversion"), (3, "chronology"), (4, "misattribution"), (5, "provenance")}


def test_lcs_is_that_of_the_table():
    import random

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rnd = random.Random(5)
    for _ in range(300):
        a, b = (rnd.choices("abcdefgh"[: rnd.randint(1, 8)], k=rnd.randint(0, 90)) for _ in range(2))
        assert code.lcs_length(a, b) == table(a, b)


def test_metrics_read_whole_texts(spark, tmp_path):
    from annalist.plans.queries import QUERIES

    head = "same words at the front " * 30  # 720 characters, 150 words
    texts = [f"{head}{head}see PR #1", f"{head[:-1]}, {head}harbour", "one otherwise", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["f13_f15_metrics"](spark, str(tmp_path)).collect()}
    assert got[0].citation_f1 == 1.0 and got[1].citation_f1 == 0.0
    for i, text in enumerate(texts[:3]):
        a, b = (x.lower().replace("#", " ").replace(",", " ").split() for x in (text[: len(text) // 2], text[len(text) // 2 :]))
        assert got[i].rouge_l == round(2 * code.lcs_length(a, b) / (len(a) + len(b)), 6)
    assert got[2].rouge_l == 0.0 and got[3].rouge_l == 0.0


def test_word_overlap_is_that_of_expressions(spark):
    rows = spark.createDataFrame([("The Harbour bridge", "harbour bridges spree town"), ("", "some words"), ("abcdef", "bcde zzzz naïvety"), (None, "some"), ("x", "")], "a string, b string")
    words = F.array_distinct(F.filter(F.split(F.lower("b"), r"\W+"), lambda w: F.length(w) >= 4))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("a"), w)))
    want = F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / (0.4 * F.size(words))))
    assert all(r.x == pytest.approx(r.y) for r in rows.select(evaluate.keyword_overlap(F.col("a"), F.col("b")).alias("x"), want.alias("y")).collect())


def test_exact_channel_without_a_limit(spark):
    n = 1_000_050
    chunks = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("see #7").alias("text"), F.lit("x").alias("source_id"), F.lit("commit").alias("source_type"))
    assert search.exact_channel(chunks, [], [7], limit=None).count() == n
    assert search.exact_channel(chunks, [], [7], limit=3).count() == 3
