"""Tables between steps, in the folder that the cluster names, and the versioned store of a history.

A store is a folder of data folders and manifests. A manifest names the data folders of every table in one version; versions
are numbered, and the latest is what readers see. A writer adds data folders that no manifest names yet, then writes the
next manifest beside the others and renames it into place: the rename is the commit of all its tables at once, and it
fails if another writer has taken the number. Data folders are never changed, so a reader that keeps to its version sees
its rows until ``vacuum`` removes the version.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local one does, but only where driver and executors are one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"file://{tempfile.gettempdir()}/annalist-shared-{os.getpid()}"


def written(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (or ``within`` another): later reads survive lost executors and recompute nothing."""
    path = f"{within or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(Exception):
    """Another writer has committed a version since this one began."""


class Files:
    """What a store does with files besides Spark's reads and writes, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def names(self, at: str) -> list[tuple[str, float]]:
        """(name, time of the last change in seconds) of what lies in a folder; nothing where there is none."""
        if not self.fs.exists(self.path(at)):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(at))]

    def read(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, at: str, text: str) -> None:
        """A file that appears whole or not at all; FileExistsError if it is there."""
        held = f"{at}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(held), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(held).toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(held), self.path(at), options)
        except Exception as e:
            self.delete(held)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(at) from None
            raise

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)


class Version:
    """One version of a store's tables: reads see it alone, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, folder: str, number: int, entries: dict):
        self.spark, self.folder, self.number, self.entries = spark, folder, number, entries

    def parts(self, name: str) -> list[str]:
        return [f"{self.folder}/{p}" for p in self.entries.get("tables", {}).get(name, [])]

    def facts(self, name: str):
        """A small value that was committed with the tables, or None."""
        return self.entries.get("facts", {}).get(name)

    def table(self, name: str) -> DataFrame:
        """A table of the history model, with its schema; empty where nothing has been stored yet."""
        from annalist.schemas import SCHEMAS, empty

        parts = self.parts(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts) if parts else empty(self.spark, name)


class Transaction(Version):
    """Tables to be committed as one version; reads see what this transaction has written."""

    def __init__(self, base: Version):
        entries = json.loads(json.dumps(base.entries))
        super().__init__(base.spark, base.folder, base.number, entries)
        self.scratch = f"{shared_folder(base.spark)}/scratch-{uuid.uuid4().hex}"

    def _add(self, df: DataFrame, name: str) -> str:
        at = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{at}")
        return at

    def replace(self, df: DataFrame, name: str) -> None:
        self.entries.setdefault("tables", {})[name] = [self._add(df, name)]

    def append(self, df: DataFrame, name: str) -> None:
        self.entries.setdefault("tables", {}).setdefault(name, []).append(self._add(df, name))

    def keep(self, name: str, value) -> None:
        self.entries.setdefault("facts", {})[name] = value

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """A table between the steps of this transaction; it goes when the transaction ends."""
        return written(df, name, self.scratch)


class Store:
    """The versions of a folder."""

    KEEP, SECONDS = 2, 3600.0  # versions that vacuum leaves, and the age from which it removes files that no version names

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, folder)

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"(\d{12})\.json", n) for n, _ in self.files.names(f"{self.folder}/versions"))
        return sorted(int(m[1]) for m in found if m)

    def version(self, number: int | None = None) -> Version:
        """A version by number, or the latest; one without tables where nothing is committed."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return Version(self.spark, self.folder, 0, {})
            number = numbers[-1]
        return Version(self.spark, self.folder, number, json.loads(self.files.read(f"{self.folder}/versions/{number:012}.json")))

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """``with store.transaction() as t``: commits at the end of the block; an error in it commits nothing."""
        t = Transaction(self.version())
        try:
            yield t
            try:
                self.files.write_new(f"{self.folder}/versions/{t.number + 1:012}.json", json.dumps({**t.entries, "written": time.time()}))
            except FileExistsError:
                raise Conflict(f"version {t.number + 1} of {self.folder} is there") from None
        finally:
            Files(self.spark, t.scratch).delete(t.scratch)

    def vacuum(self, keep: int | None = None, seconds: float | None = None) -> int:
        """Remove all versions but the last ``keep``, and what no version names for ``seconds``; the number of data folders removed.

        Younger files that no version names may be those of a writer that is at work.
        """
        keep, seconds = self.KEEP if keep is None else max(keep, 1), self.SECONDS if seconds is None else seconds
        numbers = self.numbers()
        named = {p for n in numbers[-keep:] for parts in self.version(n).entries.get("tables", {}).values() for p in parts}
        for n in numbers[:-keep]:
            self.files.delete(f"{self.folder}/versions/{n:012}.json")
        gone, now = 0, time.time()
        for at in ("data", "versions"):
            for name, changed in self.files.names(f"{self.folder}/{at}"):
                if f"{at}/{name}" not in named and now - changed >= seconds and not name.endswith(".json"):
                    self.files.delete(f"{self.folder}/{at}/{name}")
                    gone += at == "data"
        return gone


def stored_meta(version: Version, repo_id: str | None = None) -> dict | None:
    """The stored facts of a repository, or of the one that was updated last."""
    meta = version.table("repo_meta")
    rows = meta.where(meta.repo_id == repo_id) if repo_id else meta
    first = rows.orderBy(rows.updated_at.desc_nulls_last(), rows.repo_id).limit(1).collect()
    return first[0].asDict() if first else None
