"""Readers: git log dumps, JSON exports of pull requests and issues, working trees; all parsed on the executors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.sources.git_objects import GitFiles, GitLog

# fixed values: what is not ingested of a tree
SUFFIXES = ("py", "md", "json", "ts", "js", "yml", "yaml")
EXCLUDED_DIRS = ("node_modules", ".git", "venv", ".venv", "__pycache__", "dist", "build")
EXCLUDED_FILES = ("context.md", "bugs.md", "recentbugs.md", "secrets.json")


def read_git_log(spark: SparkSession, path: str, since: str | None = None, subpath: str | None = None, revision: str | None = None) -> DataFrame:
    """Raw records of the commits that ``revision`` (by default HEAD) reaches when the read is planned."""
    spark.dataSource.register(GitLog)
    reader = spark.read.format("gitlog").option("path", path)
    for k, v in (("since", since), ("subpath", subpath), ("revision", revision)):
        reader = reader.option(k, v) if v else reader
    return reader.load()


def read_log_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump of ``git log`` in LOG_FORMAT; Spark splits it at the record separator."""
    return spark.read.option("lineSep", "\x1e").text(path).where("trim(value) != ''").select(F.col("value").alias("record"))


def parse_commits(records: DataFrame, repo_id: str) -> DataFrame:
    """Raw records to commits. Binary files count no lines; a malformed date is null; records of fewer fields are dropped."""
    head, stat = F.split("record", "\x1fNUMSTAT")[0], F.coalesce(F.get(F.split("record", "\x1fNUMSTAT"), F.lit(1)), F.lit(""))
    f = F.split(head, "\x1f", 6)
    lines = F.filter(F.transform(F.split(stat, "\n"), lambda x: F.split(x, "\t")), lambda x: F.size(x) == 3)
    number = lambda i: F.aggregate(lines, F.lit(0), lambda s, x: s + F.coalesce(x[i].try_cast("int"), F.lit(0)))
    bare = lambda i: F.btrim(f[i], F.lit(" \t\n\r\x0b\x0c"))
    out = records.where(F.size(f) == 6).select(
        F.lit(repo_id).alias("repo_id"), bare(0).alias("sha"), bare(1).alias("author_name"), bare(2).alias("author_email"),
        F.try_to_timestamp(bare(3)).alias("authored_date"), F.filter(F.split(F.trim(f[4]), " "), lambda p: p != "").alias("parents"), bare(5).alias("message"),
        F.transform(lines, lambda x: T.rename_target(x[2])).alias("files_changed"), number(0).alias("insertions"), number(1).alias("deletions"),
    )
    return out.withColumns({"is_merge": F.size("parents") > 1, "is_revert": T.is_revert(F.col("message")), "reverts_sha": T.revert_target(F.col("message"))})


def read_tree(spark: SparkSession, root: str, suffixes=SUFFIXES, exclude_tests: bool = False) -> DataFrame:
    """(file_path, text) of the source files under ``root``."""
    skip = "|".join((*EXCLUDED_DIRS, *(("tests",) if exclude_tests else ())))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    return files.where(~F.col("path").rlike(rf"/(?:{skip.replace('.', chr(92) + '.')})/")).select("path", F.decode("content", "utf-8").alias("text"))


def read_tracked(spark: SparkSession, repo: str, suffixes=SUFFIXES, parts: int | None = None) -> DataFrame:
    """(file_path, text) of the files that the repository tracks and that are there, by paths below it; blank ones are left out.

    Paths are listed by one task, then dealt over ``parts`` tasks, which read the files as UTF-8 without what is not.
    """
    spark.dataSource.register(GitFiles)
    name, folders = F.element_at(F.split("file_path", "/"), -1), F.split("file_path", "/")
    listed = spark.read.format("gitfiles").option("path", repo).load()
    wanted = listed.where(F.substring_index("file_path", ".", -1).isin(*suffixes) & F.contains(name, F.lit(".")) & ~name.isin(*EXCLUDED_FILES))
    wanted = wanted.where(~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_DIRS)))).distinct()
    dealt = wanted.repartition(parts, "file_path") if parts else wanted.repartition("file_path")

    def run(frames):
        for frame in frames:
            texts = [_content(os.path.join(repo, p)) for p in frame["file_path"]]
            yield frame.assign(text=texts)

    return dealt.mapInPandas(run, "file_path string, text string").where("text is not null")


def _content(path: str) -> str | None:
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8", errors="ignore", newline="") as f:
        text = f.read()
    return text if text.strip() else None


def read_pulls(spark: SparkSession, path: str) -> DataFrame:
    from annalist.schemas import SCHEMAS

    return spark.read.schema(SCHEMAS["pull_request"]).json(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of an export; entries that are pull requests are skipped."""
    from annalist.schemas import SCHEMAS

    return spark.read.schema(SCHEMAS["issue"] + ", pull_request string").json(path).where("pull_request is null").drop("pull_request")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, expected_answer string, expected_subject string, expected_refs array<string>").json(path)
