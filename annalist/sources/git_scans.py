"""Scans of diffs, blobs and blame: rows name what to read, the executors run git on a repository that they all reach.

Each scan maps a table of requests to a table of results, so its parallelism is the partitioning of the requests; diffs
and files come from the long-lived processes of a task (``git_objects``), blame from a process for each span. A
revision is a hash of 4 to 40 hex digits, with ``^`` or ``~n`` behind it if need be; a path stays below the repository.
What is not of that form, and what git does not find, gives a null (a diff, a blob) or no row (blame).
"""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import code
from annalist.operators import links
from annalist.sources.git_objects import Objects, command

_REVISION = re.compile(r"[0-9a-fA-F]{4,40}(?:\^|~\d{1,4})*")


def _revision(sha) -> bool:
    return isinstance(sha, str) and bool(_REVISION.fullmatch(sha))


def _path(path) -> bool:
    return isinstance(path, str) and bool(path) and not path.startswith(("/", "-")) and "\0" not in path and ".." not in path.replace("\\", "/").split("/")


def _git(repo: str, *args: str) -> str | None:
    """Output of a git command, or None if it fails."""
    done = subprocess.run(command(repo, *args), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def commit_count(repo: str, since: str | None = None) -> int:
    """Commits reachable from HEAD; 0 where there is no repository."""
    return int(_git(repo, "rev-list", "--count", "HEAD", *([f"--since={since}"] if since else [])) or 0)


def _mapped(requests: DataFrame, columns: list[str], name: str, repo: str, read) -> DataFrame:
    def run(frames):
        with Objects(repo) as objects:
            for frame in frames:
                found = [read(objects, *row) for row in frame[columns].itertuples(index=False, name=None)]
                yield frame.assign(**{name: pd.Series(found, index=frame.index, dtype=object)})

    return requests.mapInPandas(run, f"{requests._jdf.schema().toDDL()}, {name} string")


def _text(data: bytes | None) -> str | None:
    return None if data is None else data.decode("utf-8", "replace")


def with_diffs(commits: DataFrame, repo: str, max_bytes: int = 20_000, sha_col: str = "sha") -> DataFrame:
    """``commits`` with ``diff``: against the first parent, cut at ``max_bytes``."""
    return _mapped(commits, [sha_col], "diff", repo, lambda git, sha: _text(git.diff(sha, max_bytes)) if _revision(sha) else None)


def with_blobs(files: DataFrame, repo: str, sha_col: str = "sha", path_col: str = "path") -> DataFrame:
    """``files`` with ``text``: the file as it was at the revision."""
    return _mapped(files, [sha_col, path_col], "text", repo, lambda git, sha, path: _text(git.blob(sha, path)) if _revision(sha) and _path(path) else None)


def blame(spans: DataFrame, repo: str, ignore_revs: str | None = None) -> DataFrame:
    """(path, first_line, last_line, sha): the commits that last changed the lines of each span; space, moves and copies are ignored."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, first, last in frame[["path", "first_line", "last_line"]].itertuples(index=False, name=None):
                if not _path(path) or pd.isna(first) or pd.isna(last) or not 1 <= first <= last:
                    continue
                more = ["--ignore-revs-file", ignore_revs] if ignore_revs else []
                text = _git(repo, "blame", "-w", "-M", "-C", "-L", f"{int(first)},{int(last)}", "--porcelain", *more, "--", path) or ""
                rows += [(path, first, last, sha) for sha in sorted(set(re.findall(r"(?m)^([0-9a-f]{40}) \d+ \d+", text)))]
            yield pd.DataFrame(rows, columns=["path", "first_line", "last_line", "sha"])

    return spans.select("path", F.col("first_line").cast("int"), F.col("last_line").cast("int")).mapInPandas(run, "path string, first_line int, last_line int, sha string")


def explain_lines(spans: DataFrame, repo: str, commits: DataFrame, repo_id: str, diff_chars: int = 1500) -> DataFrame:
    """The blamed commits of each span with what is known of them (those of ``repo_id`` before others), and the head of their diffs."""
    order = F.struct((F.col("repo_id") == repo_id).alias("own"), "repo_id", "author_name", "authored_date", "message")
    known = commits.groupBy("sha").agg(F.max(order).alias("c")).select("sha", "c.author_name", "c.authored_date", "c.message")
    return with_diffs(blame(spans, repo).join(known, "sha", "left"), repo).withColumn("diff", F.left("diff", F.lit(diff_chars)))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(sha, path, side, line_no) of the changed lines of ``diffs`` (sha, diff)."""

    def run(frames):
        for frame in frames:
            rows = [(sha, *line) for sha, diff in frame.itertuples(index=False, name=None) for line in code.diff_lines(diff)]
            yield pd.DataFrame(rows, columns=["sha", "path", "side", "line_no"])

    return diffs.select("sha", "diff").mapInPandas(run, "sha string, path string, side string, line_no int")


def touched_symbols(commits: DataFrame, repo: str, max_bytes: int = 500_000) -> DataFrame:
    """(sha, symbols_modified): innermost symbols of the changed lines; added lines are looked up in the commit's file, deleted ones in its parent's."""

    def symbols(frames):
        for frame in frames:
            rows = []
            for sha, path, side, text in frame[["sha", "path", "side", "text"]].itertuples(index=False, name=None):
                rows += [(sha, path, side, s[0], s[3], s[4]) for s in code.symbols_of(text, path)] if text else []
            table = pd.DataFrame(rows, columns=["sha", "path", "side", "symbol_id", "start_line", "end_line"])
            yield table.astype({"start_line": "Int32", "end_line": "Int32"})

    lines = diff_lines(with_diffs(commits.select("sha").distinct(), repo, max_bytes))
    files = lines.select("sha", "path", "side").distinct().withColumn("at", F.when(F.col("side") == "deleted", F.concat("sha", F.lit("^"))).otherwise(F.col("sha")))
    images = with_blobs(files, repo, "at").mapInPandas(symbols, "sha string, path string, side string, symbol_id string, start_line int, end_line int")
    hit = links.lines_to_symbols(lines, images, ["sha", "path", "side"])
    return hit.groupBy("sha").agg(F.sort_array(F.collect_set("symbol_id")).alias("symbols_modified"))
