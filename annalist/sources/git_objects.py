"""Long-lived git processes that answer a task's requests one after another, and the readers over them.

A task keeps three processes at most: ``cat-file --batch-check`` resolves revisions, ``cat-file --batch`` gives objects, and
``diff-tree --stdin`` gives patches. An answer of the first two is framed by its size. diff-tree echoes a line that is no
object id and flushes, so each request is followed by a line that no patch can hold at its start. A process that ends
early fails the task, and Spark tries the task again.
"""

from __future__ import annotations

import contextlib
import os
import re
import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_HEADER = re.compile(rb"([0-9a-f]{40,64}) (blob|tree|commit|tag) (\d+)\n")
PART_COMMITS = 20_000
LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%s%n%b%x1fNUMSTAT"


def command(repo: str, *args: str) -> list[str]:
    return ["git", "-c", "core.quotepath=false", "-C", repo, *args]


def resolve(repo: str, revision: str = "HEAD") -> str:
    """The id of the commit that a revision names now."""
    done = subprocess.run(command(repo, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}"), capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(f"git can't read {repo}: {done.stderr.strip()}")
    return done.stdout.strip()


def remote_url(repo: str) -> str | None:
    """The https address of the code host that the remote "origin" names by https, http or ssh; None for other remotes."""
    done = subprocess.run(command(repo, "remote", "get-url", "origin"), capture_output=True, text=True, check=False)
    url = done.stdout.strip() if done.returncode == 0 else ""
    found = re.fullmatch(r"(?:https?://|(?:ssh://)?git@)github\.com[:/]([^/\s]+)/([^\s]+?)(?:\.git)?/*", url)
    return f"https://github.com/{found[1]}/{found[2]}" if found else None


def repo_id_of(repo: str) -> str:
    """owner/name of the remote, else the name of the repository's folder."""
    url = remote_url(repo)
    return "/".join(url.split("/")[-2:]) if url else os.path.basename(os.path.abspath(repo))


class Objects:
    """The objects of a repository by request; close it, or use it in a with statement."""

    DIFF = ("diff-tree", "--stdin", "--no-commit-id", "--root", "-r", "-p", "-M", "--unified=3", "--diff-merges=first-parent")

    def __init__(self, repo: str):
        self.repo, self.running = repo, {}

    def __enter__(self) -> Objects:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for run in self.running.values():
            with contextlib.suppress(BrokenPipeError):
                run.stdin.close()
            run.stdout.close()
            run.terminate()
            run.wait()
        self.running = {}

    def _process(self, *args: str) -> subprocess.Popen:
        if args not in self.running:
            self.running[args] = subprocess.Popen(command(self.repo, *args), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        return self.running[args]

    def _ask(self, request: bytes, *args: str) -> subprocess.Popen:
        run = self._process(*args)
        try:
            run.stdin.write(request)
            run.stdin.flush()
        except BrokenPipeError:
            raise OSError(f"git {args[0]} of {self.repo} ended") from None
        return run

    def _header(self, run: subprocess.Popen) -> tuple[str, str, int] | None:
        line = run.stdout.readline()
        if not line.endswith(b"\n"):
            raise OSError(f"git cat-file of {self.repo} ended")
        found = _HEADER.fullmatch(line)  # else the object is missing or its name is ambiguous
        return (found[1].decode(), found[2].decode(), int(found[3])) if found else None

    def commit(self, revision: str) -> str | None:
        """The full id of the commit that a revision names, or None."""
        found = self._header(self._ask(f"{revision}^{{commit}}\n".encode(), "cat-file", "--batch-check"))
        return found[0] if found else None

    def blob(self, revision: str, path: str) -> bytes | None:
        """The file at ``path`` as it was at the revision, or None; a path with a line break is not found."""
        if "\n" in path or "\n" in revision:
            return None
        run = self._ask(f"{revision}:{path}\n".encode("utf-8", "surrogateescape"), "cat-file", "--batch")
        found = self._header(run)
        if not found:
            return None
        data = run.stdout.read(found[2] + 1)
        if len(data) != found[2] + 1:
            raise OSError(f"git cat-file of {self.repo} ended")
        return data[:-1] if found[1] == "blob" else None

    def diff(self, revision: str, most: int | None = None) -> bytes | None:
        """The patch of a commit against its first parent, its first ``most`` bytes; None for what is no commit."""
        oid = self.commit(revision)
        if not oid:
            return None
        mark = f"end {uuid.uuid4().hex}\n".encode()
        run = self._ask(oid.encode() + b"\n" + mark, *self.DIFF)
        out, size, fresh = [], 0, True
        while True:
            line = run.stdout.readline(1 << 16)
            if not line:
                raise OSError(f"git diff-tree of {self.repo} ended")
            if fresh and line == mark:
                break
            fresh = line.endswith(b"\n")
            if most is None or size < most:
                out.append(line if most is None else line[: most - size])
                size += len(line)
        return b"".join(out)


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("path", repo)``: one raw record per commit; ``since`` and ``subpath`` narrow it.

    The commits are those reachable from ``revision`` (by default HEAD) when the read is planned: its id is resolved once and
    its commits are listed once, newest first. Each partition holds the ids of PART_COMMITS commits, as bytes, and
    reads those without a walk, so commits that are made meanwhile change nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema):
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.path = self.options["path"]
        self.tail = ["--", self.options["subpath"]] if self.options.get("subpath") else ["--"]

    def partitions(self):
        head = resolve(self.path, self.options.get("revision") or "HEAD")
        since = [f"--since={self.options['since']}"] if self.options.get("since") else []
        parts, ids = [], bytearray()
        with subprocess.Popen(command(self.path, "rev-list", *since, head, *self.tail), stdout=subprocess.PIPE) as run:
            for n, line in enumerate(run.stdout, 1):
                ids += bytes.fromhex(line.strip().decode())
                if n % PART_COMMITS == 0:
                    parts.append(InputPartition((len(head) // 2, bytes(ids))))
                    ids = bytearray()
            if run.wait():
                raise ValueError(f"git rev-list of {self.path} ended with {run.returncode}")
        return [*parts, InputPartition((len(head) // 2, bytes(ids)))] if ids or not parts else parts

    def read(self, partition):
        width, ids = partition.value
        if not ids:
            return
        asked = "".join(f"{ids[at : at + width].hex()}\n" for at in range(0, len(ids), width))
        log = command(self.path, "log", "--no-walk=unsorted", "--stdin", f"--pretty=format:{LOG_FORMAT}", "--numstat", *self.tail)
        with subprocess.Popen(log, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as git:
            git.stdin.write(asked)  # git reads all of it before it answers
            git.stdin.close()
            rest, n = "", 0
            for part in iter(lambda: git.stdout.read(1 << 16), ""):
                *whole, rest = (rest + part).split("\x1e")
                for record in whole:
                    if record.strip():
                        n += 1
                        yield (record,)
            if git.wait():  # a log that ends early is no shorter log
                raise ValueError(f"git log of {self.path} ended with {git.returncode}")
            if rest.strip():
                n += 1
                yield (rest,)
        if n != len(ids) // width and not self.options.get("subpath"):
            raise ValueError(f"git log of {self.path} gave {n} of {len(ids) // width} commits")


class GitFiles(DataSource):
    """``spark.read.format("gitfiles").option("path", repo)``: the paths that the index tracks, relative to the repository."""

    @classmethod
    def name(cls) -> str:
        return "gitfiles"

    def schema(self) -> str:
        return "file_path string"

    def reader(self, schema):
        return _GitFilesReader(self.options["path"])


class _GitFilesReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def read(self, partition) -> Iterator[tuple[str]]:
        with subprocess.Popen(command(self.path, "ls-files", "-z"), stdout=subprocess.PIPE) as run:
            rest = b""
            for part in iter(lambda: run.stdout.read(1 << 16), b""):
                *whole, rest = (rest + part).split(b"\0")
                yield from ((p.decode("utf-8", "replace"),) for p in dict.fromkeys(whole))
            if run.wait():
                raise ValueError(f"git ls-files of {self.path} ended with {run.returncode}")
