"""Scans of a scripted repository."""

import subprocess

import pytest
from pyspark.sql import functions as F

from annalist.sources import git_objects, git_scans, history


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", *args], check=True, capture_output=True)

    git("init", "-q")
    for n, text in enumerate(["def f():\n    return 1\n\n\ndef g():\n    return 2\n", "def f():\n    return 10\n\n\ndef g():\n    return 2\n", "def f():\n    return 10\n"]):
        (root / "a b.py").write_text(text)
        git("add", "-A")
        git("commit", "-qm", f"change {n}")
    return str(root)


@pytest.fixture(scope="module")
def commits(spark, repo):
    return history.parse_commits(history.read_git_log(spark, repo), "r").cache()


def test_count(repo, tmp_path):
    assert git_scans.commit_count(repo) == 3 and git_scans.commit_count(str(tmp_path)) == 0


def test_diffs_and_blobs(spark, repo, commits):
    got = {r.message: r for r in git_scans.with_diffs(commits, repo).collect()}
    assert "-    return 1\n+    return 10\n" in got["change 1"].diff
    assert all(len(r.diff) <= 30 for r in git_scans.with_diffs(commits, repo, 30).collect())
    sha = got["change 1"].sha
    asked = spark.createDataFrame([(sha, "a b.py"), (sha + "^", "a b.py"), (sha, "../a b.py"), ("--help", "a b.py"), (None, None), (sha, "none.py")], "sha string, path string")
    texts = [r.text for r in git_scans.with_blobs(asked, repo).collect()]
    assert [t and "return 10" in t for t in texts] == [True, False, None, None, None, None]
    odd = spark.createDataFrame([("HEAD; ls",), (None,), ("f" * 40,)], "sha string")
    assert [r.diff for r in git_scans.with_diffs(odd, repo).collect()] == [None] * 3


def test_touched_symbols(repo, commits):
    names = {r.sha: r.message for r in commits.collect()}
    got = {names[r.sha]: r.symbols_modified for r in git_scans.touched_symbols(commits, repo).collect()}
    assert got == {"change 0": ["a b.py::f", "a b.py::g"], "change 1": ["a b.py::f"], "change 2": ["a b.py::g"]}


def test_explain_lines(spark, repo, commits):
    spans = spark.createDataFrame([("a b.py", 1, 2), ("a b.py", 90, 99), ("/etc/passwd", 1, 1), (None, None, None)], "path string, first_line int, last_line int")
    got = git_scans.explain_lines(spans, repo, commits.withColumn("repo_id", F.lit("r")), "r").orderBy("message").collect()
    assert [(r.path, r.message, r.author_name) for r in got] == [("a b.py", "change 0", "Ann"), ("a b.py", "change 1", "Ann")]
    assert all(r.diff.startswith("diff --git") for r in got)


# --- long-lived processes and pinned reads --------------------------------------------------------------------------------


def run_git(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def odd_repo(tmp_path_factory):
    """Merges, renames, binary and empty files, a hostile file, paths with spaces and beyond ASCII, an empty commit."""
    root = tmp_path_factory.mktemp("odd")
    run_git(root, "init", "-q", "-b", "main")

    def commit(message, **files):
        for name, data in files.items():
            (root / name.replace("__", " ").replace("_dot_", ".")).write_bytes(data)
        run_git(root, "add", "-A")
        run_git(root, "commit", "-qm", message, "--allow-empty")

    commit("first", a_dot_py=b"x = 1\n" * 30, bin_dot_dat=bytes(range(256)), **{"café__x_dot_md": "tête\n".encode()})
    commit("hostile", h_dot_txt=b"0123456789abcdef0123456789abcdef01234567\nend 00\n blob 5\nmissing\n\x1e\x1f\n")
    run_git(root, "checkout", "-qb", "side")
    commit("on side", s_dot_py=b"s = 1\n")
    run_git(root, "checkout", "-q", "main")
    commit("on main", m_dot_py=b"m = 1\n")
    run_git(root, "merge", "-q", "--no-ff", "-m", "merge side", "side")
    run_git(root, "mv", "a.py", "renamed.py")
    commit("rename")
    commit("nothing")
    commit("no end", long_dot_js=b"y" * 200_000)
    return root


def test_diffs_of_one_process_equal_those_of_many(spark, odd_repo):
    shas = run_git(odd_repo, "rev-list", "HEAD").split()
    asked = spark.createDataFrame([(s,) for s in shas], "sha string").repartition(2)
    for most in (20_000, 50, 10**6):
        got = {r.sha: r.diff for r in git_scans.with_diffs(asked, str(odd_repo), most).collect()}
        for sha in shas:
            want = subprocess.run(["git", "-c", "core.quotepath=false", "-C", str(odd_repo), "show", "-m", "--first-parent", "--format=", "--unified=3", sha, "--"], capture_output=True, check=True).stdout
            assert got[sha] == want[:most].decode("utf-8", "replace"), sha


def test_one_task_starts_no_process_a_row(odd_repo, monkeypatch):
    started, popen = [], subprocess.Popen
    monkeypatch.setattr(git_objects.subprocess, "Popen", lambda *a, **k: (started.append(a[0]), popen(*a, **k))[1])
    shas = run_git(odd_repo, "rev-list", "HEAD").split()
    started.clear()
    with git_objects.Objects(str(odd_repo)) as objects:
        for sha in shas * 3:
            assert objects.diff(sha) is not None
            assert objects.blob(sha, "none.py") is None
            assert objects.blob(sha, "bin.dat") in (bytes(range(256)), None)
        assert objects.blob("HEAD", "h.txt").endswith(b"\x1e\x1f\n") and objects.blob("HEAD", "") is None
        assert objects.blob("HEAD", "café x.md").decode() == "tête\n"
        assert objects.commit("f" * 40) is None and objects.diff(objects.commit("HEAD^{tree}") or "0" * 40) is None
        assert len(started) == 3
        running = list(objects.running.values())
        running[1].kill()
        running[1].wait()
        with pytest.raises(OSError):
            for _ in range(3):
                objects.diff("HEAD")
    assert all(r.poll() is not None for r in running)


def test_a_read_is_pinned(spark, odd_repo, monkeypatch):
    monkeypatch.setattr(git_objects, "PART_COMMITS", 3)
    reader = git_objects.GitLogReader({"path": str(odd_repo)})
    want = run_git(odd_repo, "log", "--format=%H").split()
    parts = reader.partitions()
    assert len(parts) == 3
    run_git(odd_repo, "commit", "-qm", "meanwhile", "--allow-empty")
    try:
        got = [r for p in parts for (r,) in reader.read(p)]
        assert [g.strip().split("\x1f")[0] for g in got] == want
        at = history.parse_commits(history.read_git_log(spark, str(odd_repo), revision=want[0]), "r")
        assert sorted(r.sha for r in at.collect()) == sorted(want)
        merged = {r.message: r for r in at.collect()}
        assert merged["merge side"].is_merge and merged["first"].insertions == 31 and merged["rename"].files_changed == ["renamed.py"]
        assert [r.message for r in history.parse_commits(history.read_git_log(spark, str(odd_repo), subpath="s.py"), "r").collect()] == ["on side"]
    finally:
        run_git(odd_repo, "reset", "-q", "--hard", "HEAD^")
    with pytest.raises(ValueError, match="can't read"):
        git_objects.resolve(str(odd_repo), "--all")


def test_tracked_files(spark, tmp_path):
    run_git(tmp_path, "init", "-q")
    for name in ("a.py", "secrets.json", "sub/bugs.md", "sub/é.md", "node_modules/b.js", "c.txt", "blank.py", "gone.py", "py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(" " if name == "blank.py" else name)
    run_git(tmp_path, "add", "-A", "-f")
    (tmp_path / "untracked.py").write_text("x")
    (tmp_path / "gone.py").unlink()
    got = history.read_tracked(spark, str(tmp_path), parts=2).collect()
    assert sorted((r.file_path, r.text) for r in got) == [("a.py", "a.py"), ("sub/é.md", "sub/é.md")]


@pytest.mark.parametrize("url, want", [
    ("git@github.com:org/app.git", "org/app"), ("ssh://git@github.com/org/app", "org/app"), ("https://github.com/org/app.git/", "org/app"), ("http://github.com/org/app/", "org/app"), ("https://example.org/org/app", None),
])
def test_the_remote_names_a_repository(tmp_path, url, want):
    root = tmp_path / "folder"
    root.mkdir()
    run_git(root, "init", "-q")
    assert git_objects.remote_url(str(root)) is None and git_objects.repo_id_of(str(root)) == "folder"
    run_git(root, "remote", "add", "origin", url)
    assert git_objects.remote_url(str(root)) == (want and f"https://github.com/{want}") and git_objects.repo_id_of(str(root)) == (want or "folder")
