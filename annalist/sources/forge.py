"""Pull requests and issues of a code host: pages as partitions of a data source, with a cursor that a next run goes on from.

``fetch(path, page)`` returns the decoded JSON list of a page, newest change first, or raises RateLimited; it stands for the
network, so that recorded responses can stand in for it, and runs on executors. A run asks for pages in waves, each page a
task, and says in its state whether it is complete: a run that a limit of calls ends keeps where it was, and the next
run brings what has changed since and goes on behind what it has.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annalist.schemas import SCHEMAS
from annalist.storage import written

PAGE = 100
LEAST_CALLS = 5  # left of the rate limit, under which nothing is fetched
WAVE = 4  # pages that are asked for at once
# fixed values: numbers that a body names
PULL_REFS = r"(?i)(?:fixes|resolves|closes|refs)\s+#(\d+)"
ISSUE_REFS = r"(?i)(?:pr|pull request|see)\s+#(\d+)"

FRESH = {"complete": True, "newest": None, "oldest": None, "page": 1, "pending": [], "calls": 0}


class RateLimited(Exception):
    """The host refuses further calls for now."""


class Incomplete(Exception):
    """A run that a limit of calls has ended; ``state`` is what the next one goes on from."""

    def __init__(self, state: dict):
        super().__init__(f"incomplete at page {state['page']}, {len(state['pending'])} entries without comments")
        self.state = state


def _source(fetch: Callable, path: str, pages: list[int]) -> type[DataSource]:
    """A data source of (page, status, entries, body): a row for each of ``pages``, with what the host gave or that it refused."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(p) for p in pages]

        def read(self, partition) -> Iterator[tuple]:
            try:
                rows = fetch(path, partition.value)
            except RateLimited:
                yield partition.value, "limited", 0, "[]"
                return
            yield partition.value, "ok", len(rows), json.dumps(rows)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "forgepages"

        def schema(self) -> str:
            return "page int, status string, entries int, body string"

        def reader(self, schema):
            return Reader()

    return Pages


def entries_of(pages: DataFrame) -> DataFrame:
    """(page, at, number, changed, is_pull, entry): the entries of ``pages`` (page, body), each as its JSON text."""
    each = pages.select("page", F.posexplode(F.from_json("body", "array<string>")).alias("at", "entry"))
    said = lambda path: F.get_json_object("entry", path)
    return each.select("page", "at", said("$.number").try_cast("int").alias("number"), F.coalesce(said("$.updated_at"), said("$.created_at")).alias("changed"), said("$.pull_request").isNotNull().alias("is_pull"), "entry")


def rows_of(entries: DataFrame, kind: str, repo_id: str) -> DataFrame:
    """Rows of the pull_request or issue table (``kind`` pulls or issues) of ``entries`` (entry; comments and reviews as JSON lists, if
    the columns are there), with the numbers that their bodies name."""
    name, refs = ("pull_request", "linked_issue_numbers") if kind == "pulls" else ("issue", "linked_pr_numbers")
    comment = "array<struct<user:struct<login:string>,path:string,line:int,original_line:int,body:string,created_at:string>>"
    who = lambda u: F.coalesce(u, F.lit("unknown"))

    def comments(column: str):
        if column not in entries.columns:
            return F.array()
        one = lambda c: F.struct(who(c["user"]["login"]).alias("author"), who(c["user"]["login"]).alias("user"), c["path"].alias("path"), F.coalesce(c["line"], c["original_line"]).alias("line"), F.coalesce(c["body"], F.lit("")).alias("body"), c["created_at"].alias("created_at"))
        return F.coalesce(F.transform(F.from_json(column, comment), one), F.array())

    said = lambda path: F.get_json_object("entry", path)
    parsed = entries.select("*", F.from_json("entry", SCHEMAS[name].replace("labels array<string>", "labels array<struct<name:string>>")).alias("e"))
    out = parsed.select("e.*", said("$.user.login").alias("_who"), comments("comments_json").alias("_comments"), comments("reviews_json").alias("_reviews"))
    body = F.coalesce("body", F.lit(""))
    named = F.regexp_extract_all(body, F.lit(PULL_REFS if kind == "pulls" else ISSUE_REFS), F.lit(1))
    filled = {"repo_id": F.lit(repo_id), "author": who(F.col("_who")), "body": body, refs: F.array_compact(F.transform(named, lambda n: n.try_cast("int"))), "linked_commit_shas": F.coalesce("linked_commit_shas", F.array().cast("array<string>")), "comments": F.col("_comments")}
    filled |= {"review_comments": F.col("_reviews")} if kind == "pulls" else {"labels": F.coalesce(F.col("labels.name"), F.array().cast("array<string>"))}
    made = out.withColumns(filled)
    schema = made.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _with_comments(entries: DataFrame, fetch: Callable, kind: str) -> DataFrame:
    """``entries`` with their comments (and reviews) as JSON, and whether all of them came."""

    def every(path: str) -> list:
        out, page = [], 1
        while True:
            rows = fetch(path, page)
            out += rows
            if len(rows) < PAGE:
                return out
            page += 1

    def run(frames):
        for frame in frames:
            made = []
            for number in frame["number"]:
                try:
                    made.append((json.dumps(every(f"issues/{number}/comments")), json.dumps(every(f"pulls/{number}/comments") if kind == "pulls" else []), True))
                except RateLimited:
                    made.append(("[]", "[]", False))
            a, b, c = zip(*made) if made else ((), (), ())
            yield frame.assign(comments_json=a, reviews_json=b, whole=c)

    kinds = entries._jdf.schema().toDDL()
    return entries.repartition(WAVE, "number").mapInPandas(run, f"{kinds}, comments_json string, reviews_json string, whole boolean")


def run(spark: SparkSession, fetch: Callable, kind: str, repo_id: str, state: dict | None = None, limit: int = 500, since: str | None = None, token: bool = False, left: int = 5000) -> tuple[DataFrame, dict]:
    """(rows, state): what a run from ``state`` brings, and where the next one begins.

    Rows are those of the pull_request or issue table; comments only with a ``token``. A run takes up to ``limit`` entries that have
    changed at ``since`` or later (both ISO texts) and may make ``left`` calls for pages. It is complete when it has met the
    end, the limit, or what an earlier complete run knew; else its state says so and keeps the page, the changes it has
    seen (newest to oldest), and the numbers of entries whose comments were refused, which come with a later run.
    """
    state = {**FRESH, **(state or {})}
    spent, got, seen, parts, done = 0, 0, [], [], left < LEAST_CALLS
    limited = done
    known_to = state["newest"]  # all between it and ``oldest`` is known; of a complete run, all that is older too
    behind = None if state["complete"] else state["oldest"]
    page, resumed = 1, state["page"]
    while not done:
        asked = list(range(page, page + min(WAVE, left - spent)))
        if not asked:
            limited = True
            break
        spent += len(asked)
        source = _source(fetch, kind, asked)
        spark.dataSource.register(source)
        wave = written(spark.read.format("forgepages").load(), "pages")
        status = {r.page: (r.status, r.entries) for r in wave.select("page", "status", "entries").collect()}
        usable = []
        for p in asked:
            if status[p][0] == "limited":
                limited = done = True
                break
            usable.append(p)
            page = p + 1
            if status[p][1] < PAGE:
                done = True
                break
        found = entries_of(wave.where(F.col("page").isin(*usable)))
        found = found.where(~F.col("is_pull")) if kind == "issues" else found
        facts = sorted((r.page, r.at, r.changed, r.number) for r in found.select("page", "at", "changed", "number").collect())
        wanted = []
        for _, _, changed, number in facts:
            if since and changed and changed < since:
                done = True
                break
            if known_to and changed and changed <= known_to:
                if behind is None:  # an earlier run has brought the rest
                    done = True
                    break
                if changed >= behind:
                    continue
            if got >= limit:
                done = True
                break
            got += 1
            seen.append(changed)
            wanted.append(number)
        if wanted:
            parts.append(found.where(F.col("number").isin(*wanted)))
        if behind and not done and facts and facts[-1][2] and known_to and facts[-1][2] <= known_to and page < resumed:
            page = resumed - 1  # what is between is known; changes since have moved entries to later pages only
    dates = [c for c in [*seen, state["newest"], state["oldest"]] if c]
    complete = not limited
    out = {"complete": complete, "newest": max(dates, default=None), "oldest": min(dates, default=None), "page": 1 if complete else max(page, 1), "pending": [], "calls": state["calls"] + spent}
    entries = parts[0] if parts else spark.createDataFrame([], "page int, at int, number int, changed string, is_pull boolean, entry string")
    for p in parts[1:]:
        entries = entries.unionByName(p)
    if token:
        again = [n for n in state["pending"]]
        if again and not limited:
            late = [(0, i, n, None, False, json.dumps(fetch(f"{kind}/{n}", 1)[0])) for i, n in enumerate(again)]
            entries = entries.unionByName(spark.createDataFrame(late, entries.schema)).dropDuplicates(["number"])
        entries = written(_with_comments(entries.dropDuplicates(["number"]), fetch, kind), "entries")
        out["pending"] = sorted({r.number for r in entries.where("not whole").select("number").collect()} | set(again if limited else ()))
        out["complete"] = complete and not out["pending"]
        entries = entries.where("whole")
    return rows_of(entries.dropDuplicates(["number"]), kind, repo_id), out


def read(spark: SparkSession, fetch: Callable, kind: str, repo_id: str, **options) -> DataFrame:
    """The rows of one run that has to be complete; else Incomplete is raised."""
    rows, state = run(spark, fetch, kind, repo_id, **options)
    if not state["complete"]:
        raise Incomplete(state)
    return rows
