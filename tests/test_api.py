"""The stored history end to end over a scripted repository, its tools and front ends; recorded pages of a code host."""

import io
import json
import subprocess
from datetime import date

import pytest
from pyspark.sql import functions as F

from annalist import __main__ as front, api
from annalist.operators import merge, search, vectors
from annalist.sources import forge, history
from annalist.storage import Store, stored_meta


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*args, who="Ann"):
        subprocess.run(["git", "-C", str(root), "-c", f"user.name={who}", "-c", f"user.email={who.lower()}@x.org", *args], check=True, capture_output=True)

    def change(name, text, message, who="Ann"):
        (root / name).write_text(text)
        git("add", "-A")
        git("commit", "-qm", message, who=who)

    git("init", "-q")
    change("auth.py", "def login():\n    return 1\n", "Add login")
    change("limiter.py", "def limit():\n    return 10\n", "Add rate limiter (#101)\n\nFixes #7", "Bob")
    change("auth.py", "def login():\n    return 2\n", "Harden login token check")
    git("revert", "--no-edit", "HEAD")
    change("café.py", "def tea():\n    return 3\n", "Add tea")
    return root


def embed(texts):
    return [search.mock_vector(t, 16) for t in texts]


@pytest.fixture(scope="module")
def store(spark, repo, tmp_path_factory):
    pulls = spark.createDataFrame([(101, "Rate limiter", "Fixes #7"), (102, "Later", "")], "number int, title string, body string")  # no link arrays: they follow from the texts
    issues = spark.createDataFrame([(7, "Too many calls", "see PR #101"), (8, "Same", "mended by #102")], "number int, title string, body string")
    h = api.History(spark, str(tmp_path_factory.mktemp("tables")), embed, 16)
    h.ingest(str(repo), "org/app", pulls=pulls, issues=issues)
    return h


def test_ingested_tables(store, repo):
    commits = {r.message.split("\n")[0]: r for r in store.table("commit").collect()}
    assert len(commits) == 5
    undone, by = commits["Harden login token check"], commits['Revert "Harden login token check"']
    assert by.reverts_sha == undone.sha and undone.superseded_by_sha == by.sha
    assert commits["Add tea"].files_changed == ["café.py"] and commits["Add tea"].symbols_modified == ["café.py::tea"]
    assert commits["Add login"].diff_summary.startswith("Files modified (1): auth.py")
    assert {r.symbol_id: r.commit_count for r in store.table("symbol_index").collect()} == {"auth.py::login": 3, "limiter.py::limit": 1, "café.py::tea": 1}
    edges = {(r.source_id.split(":")[0], r.target_id.split(":")[0], r.edge_type) for r in store.table("causal_edges").collect()}
    assert {("issue", "pr", "resolves"), ("commit", "commit", "reverts"), ("commit", "symbol", "modifies")} <= edges
    assert {r.source_type for r in store.table("chunk").select("source_type").distinct().collect()} == {"commit", "pr", "issue", "file", "code"}
    assert stored_meta(store.version())["repo_name"] == "app"
    pulls = {r.number: r.linked_issue_numbers for r in store.table("pull_request").collect()}
    assert pulls == {101: [7], 102: [8]} and {r.number: r.linked_pr_numbers for r in store.table("issue").collect()} == {7: [101], 8: [102]}
    assert {(r.source_id, r.target_id) for r in store.table("causal_edges").where("edge_type = 'resolves'").collect()} == {("issue:#7", "pr:#101"), ("issue:#8", "pr:#102")}
    limiter = commits["Add rate limiter (#101)"]
    assert "PR #101: Rate limiter" in limiter.diff_summary
    related = {r.source_id: r.related_ids for r in store.table("chunk").where("source_type = 'commit'").collect()}
    assert related[limiter.sha] == ["pr#101", "pr#7"]


def test_vectors_and_index_follow_the_chunks(store):
    chunks = {r.id: r for r in store.table("chunk").collect()}
    assert all(r.embedded for r in chunks.values())
    stored = {r.id: r.embedding for r in store.table("vector").collect()}
    assert set(stored) == set(chunks) and [round(x, 5) for x in stored[min(stored)]] == [round(x, 5) for x in search.mock_vector(chunks[min(stored)].text, 16)]
    asked = store.spark.createDataFrame([(0, "login tea limiter")], "query_id int, query string")
    same = lambda fitted: {r.id: round(r.score, 9) for r in search.bm25_search(fitted, asked).collect()}
    assert same(store.index().fitted()) == same(search.bm25_fit(store.table("chunk")))
    text = next(r.text for r in chunks.values() if r.source_type == "code")
    assert api.call(store, "search_history", {"query": text, "limit": 1})[0]["text"] == text  # the dense channel knows it


def test_a_reader_keeps_its_version(store):
    before, number = store.at(), store.version().number
    commits = before.table("commit")
    n = commits.count()
    store.store(store.table("commit").limit(1), "commit")
    assert store.version().number == number + 1 and store.table("commit").count() == 1
    assert before.table("commit").count() == n == commits.count()
    store.store(before.table("commit"), "commit")


def test_a_killed_ingestion_leaves_the_version_before(store, repo, monkeypatch):
    number, n = store.version().number, store.table("commit").count()
    (repo / "later.py").write_text("def later():\n    return 1\n")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", "commit", "-qm", "Later"], check=True)
    try:
        with monkeypatch.context() as m:
            m.setattr(merge, "upsert_meta", lambda *_: 1 / 0)  # the last step
            with pytest.raises(ZeroDivisionError):
                store.ingest(str(repo), "org/app")
        assert store.version().number == number and store.table("commit").count() == n
    finally:
        subprocess.run(["git", "-C", str(repo), "reset", "-q", "--hard", "HEAD^"], check=True)


def test_second_ingestion_adds_only_what_is_new(store, repo):
    before = {t: store.table(t).count() for t in ("commit", "chunk", "symbol_index", "causal_edges", "repo_meta")}
    merged = merge.mark_embedded(store.table("chunk"), store.table("chunk"))
    store.store(merged, "chunk")
    store.ingest(str(repo), "org/app")
    assert before == {t: store.table(t).count() for t in before}
    assert store.table("chunk").where("embedded").count() == before["chunk"]
    assert store.table("pull_request").orderBy("number").first().title == "Rate limiter"


def test_tools(store, repo):
    assert api.call(store, "repo_hotspots", {"top_n": 1}) == [{"file_path": "auth.py", "commit_count": 3}]
    assert {r["author"]: r["commit_count"] for r in api.call(store, "repo_ownership", {"repo_id": "ORG/app"})}.get("Bob") == 1
    assert len(api.call(store, "symbol_history", {"symbol": "login"})) == 3
    assert api.call(store, "repo_symbols", {"top_n": 1})[0]["symbol_id"] == "auth.py::login"
    assert {(r["kind"], r["key"]) for r in api.call(store, "find_related_discussion", {"ref": "101"})} >= {("pr", "101"), ("issue", "7")}
    assert api.call(store, "graph_topology", {})["total_edges"] == store.table("causal_edges").count()
    assert [r["message"].split("\n")[0] for r in api.call(store, "blame_explain", {"path": str(repo), "file_path": "limiter.py", "first_line": 1, "last_line": 2})] == ["Add rate limiter (#101)"]
    assert [r["author_name"] for r in api.call(store, "why", {"target": "limiter.py:1-2", "path": str(repo)})] == ["Bob"]
    with pytest.raises(ValueError):
        api.call(store, "why", {"target": "limiter.py"})
    found = api.call(store, "search_history", {"query": "rate limiter", "limit": 3})
    assert any("limiter" in r["text"] for r in found)
    with pytest.raises(ValueError):
        api.call(store, "repo_hotspots", {"drop": 1})
    with pytest.raises(ValueError):
        api.call(store, "store", {})


def test_questions(store):
    hints = store.plan("why was #101 made, and what does limiter do?")["hints"]
    assert "Pull Request #101: Rate limiter" in hints
    got = store.ask("who added the rate limiter in #101?", 2024)
    assert got["passed"] and "limiter" in got["answer"] and got["evidence"], got
    assert any(r.source_type == "issue" for r in store.evidence("rate limiter", 2024, limit=40))  # over the links of the pull
    asked = []
    wrong = store.ask("rate limiter", 2024, write=lambda q, e: asked.append(q) or "It came with #9999.")
    assert len(asked) == api.RETRIES + 1
    assert not wrong["passed"] and "9999" in wrong["answer"].split("Unverified")[1]
    assert store.evidence("rate limiter", 2024, repo_id="nobody")  # tried again without the filter
    assert api.decompose("a", lambda q: ["b", " "]) == ["b"] and api.decompose("a") == ["a"]


def test_front_ends(store, spark, capsys):
    front.main(["--folder", store.folder, "repo-hotspots", "--top-n", "1"], spark)
    assert json.loads(capsys.readouterr().out) == [{"file_path": "auth.py", "commit_count": 3}]
    calls = [{"id": 1, "tool": "status"}, {"id": 2, "tool": "none"}, {"id": 3, "tool": "list"}]
    out = io.StringIO()
    front.serve(store, io.StringIO("\n".join(json.dumps(c) for c in calls) + "\n\nnot json\n[]\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, None, None]
    assert {r["table_name"] for r in got[0]["result"]} == {"commit", "pull_request", "issue", "chunk"}
    assert "error" in got[1] and "ask" in got[2]["result"] and "error" in got[3] and "error" in got[4]


def test_windows():
    assert api.window_since("1y", date(2024, 12, 31)) == "2024-01-01" and api.window_since("full", date(2024, 1, 1)) is None
    with pytest.raises(ValueError):
        api.window_since("3m", date(2024, 1, 1))


def test_missing_repository_raises(spark, tmp_path):
    with pytest.raises(Exception, match="can't read"):
        history.read_git_log(spark, str(tmp_path / "none")).collect()


def test_recorded_pages_of_a_host(spark):
    def fetch(path, page):
        if path == "pulls":
            return [{"number": 1000 - i - 100 * (page - 1), "title": "t", "body": "Fixes #5, see #6" if i == 0 else None, "updated_at": f"2024-0{4 - page}-01", "user": {"login": "ann"}} for i in range(100 if page < 3 else 10)]
        if path == "issues":
            return [{"number": 1, "title": "i", "user": None}, {"number": 2, "pull_request": {}, "title": "p"}]
        if page > 1:
            raise forge.RateLimited
        return [{"body": "said", "user": {"login": "bob"}}] * 100

    pulls = forge.read(spark, fetch, "pulls", "r", limit=500).orderBy(F.desc("number")).collect()
    assert len(pulls) == 210 and pulls[0].linked_issue_numbers == [5] and pulls[0].author == "ann" and pulls[1].body == ""
    assert forge.read(spark, fetch, "pulls", "r", limit=150).count() == 150
    assert forge.read(spark, fetch, "pulls", "r", since="2024-02-15").count() == 100
    with pytest.raises(forge.Incomplete):
        forge.read(spark, fetch, "pulls", "r", left=4)
    rows, state = forge.run(spark, fetch, "issues", "r", token=True)  # the second page of comments is refused
    assert rows.count() == 0 and state["pending"] == [1] and not state["complete"]
    assert [(r.number, r.author) for r in forge.read(spark, fetch, "issues", "r").collect()] == [(1, "unknown")]


def test_a_limited_run_goes_on_from_its_cursor(spark, monkeypatch):
    monkeypatch.setattr(forge, "PAGE", 3)
    monkeypatch.setattr(forge, "WAVE", 2)
    changed = {n: f"2024-01-{n:02}" for n in range(1, 21)}

    def fetch_from(changed, last):
        def fetch(path, page):
            if path.startswith("pulls/") and not path.endswith("comments"):
                return [{"number": int(path.split("/")[1]), "title": "late"}]
            if path.endswith("comments"):
                if int(path.split("/")[1]) == 13 and last < 99:
                    raise forge.RateLimited
                return [{"body": "said", "user": {"login": "bob"}}]
            if page >= last:
                raise forge.RateLimited
            order = sorted(changed, key=lambda n: changed[n], reverse=True)[3 * (page - 1) : 3 * page]
            return [{"number": n, "title": f"t{n}", "updated_at": changed[n]} for n in order]

        return fetch

    rows, state = forge.run(spark, fetch_from(changed, 4), "pulls", "r")
    assert sorted(r.number for r in rows.collect()) == list(range(12, 21)) and not state["complete"] and state["oldest"] == "2024-01-12"
    changed = {**changed, 2: "2024-02-01", 21: "2024-02-02"}  # meanwhile one old pull changes and one is new
    rows, state = forge.run(spark, fetch_from(changed, 6), "pulls", "r", state)
    got = sorted(r.number for r in rows.collect())
    assert {2, 21} <= set(got) and not set(got) & set(range(12, 21)) and not state["complete"]
    rows, state = forge.run(spark, fetch_from(changed, 99), "pulls", "r", state)
    assert sorted(got + [r.number for r in rows.collect()]) == [*range(1, 12), 21] and state["complete"]
    rows, state = forge.run(spark, fetch_from(changed, 99), "pulls", "r", state)
    assert rows.count() == 0 and state["complete"]
    rows, state = forge.run(spark, fetch_from(changed, 98), "pulls", "r", token=True)
    assert state["pending"] == [13] and rows.count() == 20 and all(len(r.comments) == 1 == len(r.review_comments) for r in rows.collect())
    rows, state = forge.run(spark, fetch_from(changed, 99), "pulls", "r", state, token=True)
    assert [(r.number, r.title) for r in rows.collect()] == [(13, "late")] and state["complete"]


def test_a_host_is_ingested_in_runs(spark, tmp_path):
    def fetch(path, page):
        if path == "pulls" and page == 1:
            return [{"number": 3, "title": "p", "body": "Fixes #4", "updated_at": "2024-01-03", "user": {"login": "ann"}}]
        if path == "issues":
            raise forge.RateLimited
        return []

    h = api.History(spark, str(tmp_path))
    assert {k: s["complete"] for k, s in h.ingest_host(fetch, "org/app").items()} == {"pulls": True, "issues": False}
    assert h.table("issue").count() == 0 and not h.version().facts("host:org/app:issues")["complete"]
    issues = lambda path, page: [{"number": 4, "title": "i", "body": None}] if path == "issues" and page == 1 else []
    assert h.ingest_host(issues, "org/app")["issues"]["complete"]
    assert h.table("pull_request").first().linked_issue_numbers == [4] and h.table("issue").first().linked_pr_numbers == [3]


def test_unstored_tables_are_empty(spark, tmp_path):
    empty = Store(spark, str(tmp_path)).version()
    assert empty.number == 0 and empty.table("commit").count() == 0 and stored_meta(empty) is None


def test_pending_embeddings(spark):
    chunks = spark.createDataFrame([("a", "x", False), ("b", "y", True), ("c", None, False)], "id string, text string, embedded boolean")
    got = {r.id: r.embedding for r in merge.embed_pending(chunks, search.mock_embedding(8)).collect()}
    assert sorted(got) == ["a", "c"] and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    assert [round(x, 5) for x in got["a"]] == [round(x, 5) for x in search.mock_vector("x", 8)]
    assert merge.reset_embeddings(chunks).where("embedded").count() == 0

    def call(texts):
        raise OSError("no provider")

    rows = vectors.embed(chunks, call, dimension=8).collect()
    assert len(rows) == 3 and not any(r.embedded for r in rows)


def test_partitions_are_overwritten_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, v int")
    merge.write_partitions(rows, f"{tmp_path}/t")
    merge.write_partitions(rows.where("repo_id = 'a'").withColumn("v", F.lit(9)), f"{tmp_path}/t")
    assert sorted((r.repo_id, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]


def test_trees_and_exports(spark, tmp_path):
    for name in ("a.py", "node_modules/b.py", "tests/c.py", "d.txt", "e.md"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    names = lambda **more: sorted(r.text for r in history.read_tree(spark, str(tmp_path / "t"), **more).collect())
    assert names() == ["a.py", "e.md", "tests/c.py"] and names(suffixes=("py",), exclude_tests=True) == ["a.py"]
    (tmp_path / "i.json").write_text('{"number": 1, "title": "x"}\n{"number": 2, "pull_request": {"url": "u"}}\n')
    assert [r.number for r in history.read_issues(spark, str(tmp_path / "i.json")).collect()] == [1]
    (tmp_path / "q.jsonl").write_text('{"question": "q", "expected_refs": ["pr#1"]}\n')
    assert history.read_qa(spark, str(tmp_path / "q.jsonl")).first().expected_refs == ["pr#1"]
