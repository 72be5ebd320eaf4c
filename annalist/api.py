"""A stored history and the tools over it: ingestion of a repository, the questions a front end asks, and an offline answer.

Tables lie in one folder that driver and executors reach, as versions (``storage``): an ingestion commits all its tables and
the lexical index at once, and one that dies leaves the version before it. A tool reads one version from beginning to end.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import code, text as T
from annalist.operators import analytics, chunking, graph, links, merge, search, vectors, verify
from annalist.operators.index import Index
from annalist.schemas import empty
from annalist.sources import forge, git_objects, git_scans, history
from annalist.storage import Store, Transaction, Version, written

ANSWER_ROWS = 15  # chunks that an offline answer shows
ANSWER_CHARS = 24_000  # of their texts
RETRIES = 2  # of a question that finds nothing, each with fewer filters; or whose draft has unverified claims


def window_since(window: str, as_of: datetime.date) -> str | None:
    """The first day of a window of history (6m, 1y, 2y, full), or an error."""
    if window not in T.DAYS_OF_WINDOW:
        raise ValueError(f"a window is one of {', '.join(T.DAYS_OF_WINDOW)}")
    days = T.DAYS_OF_WINDOW[window]
    return None if days is None else (as_of - datetime.timedelta(days=days)).isoformat()


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a stored table; those it lacks are null."""
    schema = empty(df.sparkSession, name).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def decompose(question: str, split: Callable[[str], list[str]] | None = None) -> list[str]:
    """Sub-questions; without a model, the question itself."""
    return [q for q in (split(question) if split else [question]) if q.strip()] or [question]


class History:
    """The stored tables of a folder, and what can be asked of them.

    ``embed`` maps a list of texts to vectors of ``dimension`` numbers; with it chunks are embedded as they are ingested, and
    searches have a dense channel.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[list[str]], list] | None = None, dimension: int = 384):
        self.spark, self.folder, self.embed, self.dimension = spark, folder, embed, dimension
        self.stored = Store(spark, folder)
        self.pinned: Version | None = None

    def at(self, number: int | None = None) -> History:
        """This history as it is in one version (by default the latest), whatever is committed meanwhile."""
        out = History(self.spark, self.folder, self.embed, self.dimension)
        out.pinned = self.stored.version(number)
        return out

    def version(self) -> Version:
        return self.pinned or self.stored.version()

    def table(self, name: str) -> DataFrame:
        return self.version().table(name)

    def index(self) -> Index:
        v = self.version()
        return Index(self.spark, f"{v.folder}/data", v.facts("index"))

    def store(self, df: DataFrame, name: str) -> None:
        """Replace one table, as a version of its own; what follows from chunks (the index) with it."""
        with self.stored.transaction() as t:
            before = t.table(name)
            t.replace(conform(df, name), name)
            if name == "chunk":
                self._indexed(t, before)

    # --- ingestion --------------------------------------------------------------------------------------------------------

    def ingest(self, path: str, repo_id: str | None = None, window: str = "full", as_of: datetime.date | None = None, pulls: DataFrame | None = None, issues: DataFrame | None = None) -> None:
        """Add what is new of the repository at ``path``, with the pulls and issues that are given, and renew all that follows.

        Without ``repo_id`` the remote names it, else the folder. The history is that of HEAD when the ingestion begins. Link arrays of pulls and issues grow by what their texts name.
        """
        since = window_since(window, as_of) if as_of else None
        repo_id, url = repo_id or git_objects.repo_id_of(path), git_objects.remote_url(path)
        head = git_objects.resolve(path)
        with self.stored.transaction() as t:
            commits = self._commits(t, path, repo_id, since, head)
            pulls, issues = self._discussions(t, repo_id, pulls, issues)
            commits = self._with_footprints(t, commits, pulls)
            t.replace(conform(commits, "commit"), "commit")
            commits = t.table("commit")
            files = t.written(history.read_tracked(self.spark, path).withColumn("repo_id", F.lit(repo_id)), "files")
            t.replace(self._merged_symbols(t, files, commits, repo_id), "symbol_index")
            t.replace(conform(links.materialise_edges(commits, pulls, issues), "causal_edges"), "causal_edges")
            self._chunked(t, files, commits, pulls, issues, repo_id)
            now = F.current_timestamp()
            meta = self.spark.range(1).select(F.lit(repo_id).alias("repo_id"), F.lit(repo_id.rsplit("/", 1)[-1]).alias("repo_name"), F.lit(url).cast("string").alias("repo_url"), now.alias("last_ingested_at"), now.alias("created_at"), now.alias("updated_at"))
            t.replace(conform(merge.upsert_meta(t.table("repo_meta"), conform(meta, "repo_meta")), "repo_meta"), "repo_meta")
        self.stored.vacuum()

    def ingest_host(self, fetch: Callable, repo_id: str, **options) -> dict:
        """Add what a code host has of pulls and issues (``forge.run``), from where the last run ended; the states of both.

        A run that a limit of calls ends is stored with its state, and the next one goes on from there.
        """
        states = {}
        with self.stored.transaction() as t:
            rows = {}
            for kind in ("pulls", "issues"):
                key = f"host:{repo_id}:{kind}"
                found, states[kind] = forge.run(self.spark, fetch, kind, repo_id, t.facts(key), **options)
                rows[kind] = t.written(found, kind)
                t.keep(key, states[kind])
            self._discussions(t, repo_id, rows["pulls"], rows["issues"])
        return states

    def _commits(self, t: Transaction, path: str, repo_id: str, since: str | None, head: str) -> DataFrame:
        found = history.parse_commits(history.read_git_log(self.spark, path, since, revision=head), repo_id)
        stored = t.table("commit")
        new = t.written(links.new_rows(found, stored, ["repo_id", "sha"]), "new")
        touched = git_scans.touched_symbols(new, path)
        new = new.drop("reverts_sha").join(touched, "sha", "left").withColumn("symbols_modified", F.coalesce("symbols_modified", F.array().cast("array<string>")))
        commits = t.written(stored.unionByName(conform(new, "commit")), "commits")
        done = t.written(links.resolve_reverts(commits), "reverts")
        after = links.superseded(done, commits)
        commits = commits.drop("reverts_sha", "superseded_by_sha").join(done.select("repo_id", "sha", "reverts_sha"), ["repo_id", "sha"], "left")
        return commits.join(after, ["repo_id", "sha"], "left")

    def _discussions(self, t: Transaction, repo_id: str, pulls: DataFrame | None, issues: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The stored pulls and issues with the incoming ones, linked by what their texts name."""
        rows = []
        for name, incoming in (("pull_request", pulls), ("issue", issues)):
            merged = t.table(name)
            if incoming is not None:
                merged = merge.upsert(merged, conform(incoming.withColumn("repo_id", F.lit(repo_id)), name), ["repo_id", "number"], ("author", "created_at"))
            lists = [f.name for f in merged.schema if f.dataType.typeName() == "array"]
            rows.append(t.written(merged.withColumns({c: F.coalesce(c, F.array()) for c in lists}), name))
        for name, linked in zip(("pull_request", "issue"), links.link_pulls_and_issues(*rows)):
            t.replace(conform(linked, name), name)
        return t.table("pull_request"), t.table("issue")

    def _with_footprints(self, t: Transaction, commits: DataFrame, pulls: DataFrame) -> DataFrame:
        commits = t.written(commits.drop("diff_summary"), "commits")
        prints = chunking.footprint(commits, links.linked_pulls(pulls, commits), pulls)
        return commits.join(prints, ["repo_id", "sha"], "left")

    def _merged_symbols(self, t: Transaction, files: DataFrame, commits: DataFrame, repo_id: str) -> DataFrame:
        found = code.with_symbols(files).dropDuplicates(["symbol_id"])
        counted = analytics.symbol_counts(commits, found.select("repo_id", "symbol_id", "file_path", "symbol_name", "kind"))
        return t.table("symbol_index").where(F.col("repo_id") != repo_id).unionByName(conform(counted, "symbol_index"))

    def _chunked(self, t: Transaction, files: DataFrame, commits: DataFrame, pulls: DataFrame, issues: DataFrame, repo_id: str) -> None:
        linked = links.pull_of_commit(pulls, commits)
        made = [chunking.chunk_commits(commits, linked), chunking.chunk_pulls(pulls), chunking.chunk_issues(issues), chunking.chunk_files(files, t.table("symbol_index")), chunking.chunk_code(files)]
        chunks = t.written(reduce(DataFrame.unionByName, [conform(c, "chunk") for c in made]), "chunks")
        before = t.table("chunk")
        kept = merge.upsert_chunks(before, chunks)
        other = kept.where((F.col("repo_id") != repo_id) | F.col("repo_id").isNull())
        now = t.written(other.unionByName(merge.purge(kept.where(F.col("repo_id") == repo_id), chunks, ["file", "code"])), "chunks")
        if self.embed:
            found = t.written(vectors.embed(now.where(~F.col("embedded")), self.embed, dimension=self.dimension), "vectors")
            points = vectors.upsert(vectors.collection(t.table("vector"), self.dimension), found.select("id", "embedding"))
            t.replace(points.join(now.select("id"), "id", "left_semi").select("id", "embedding"), "vector")
            now = merge.mark_embedded(now, found.where("embedded"))
        t.replace(conform(now, "chunk"), "chunk")
        self._indexed(t, before)

    def _indexed(self, t: Transaction, before: DataFrame) -> None:
        """The index follows the chunks: what has changed of their texts becomes a segment."""
        index = Index(self.spark, f"{t.folder}/data", t.facts("index")).follow(before, t.table("chunk"))
        index = index.compacted() if index.needs_compaction() else index
        t.keep("index", index.facts)
        t.entries["tables"]["_index"] = [f"data/{s['at']}" for s in index.facts["segments"]]

    # --- tools ------------------------------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        return analytics.status(**{name: self.table(name) for name in ("commit", "pull_request", "issue", "chunk")})

    def repo_hotspots(self, top_n: int = 15, repo_id: str | None = None) -> DataFrame:
        return analytics.hotspots(self.table("commit"), top_n, repo_id)

    def repo_ownership(self, file_path: str | None = None, repo_id: str | None = None) -> DataFrame:
        return analytics.ownership(self.table("commit"), file_path, repo_id)

    def change_coupling(self, min_co_commits: int = 2, top_n: int = 15, repo_id: str | None = None) -> DataFrame:
        return analytics.change_coupling(self.table("commit"), min_co_commits, top_n, repo_id)

    def repo_symbols(self, top_n: int = 20, repo_id: str | None = None) -> DataFrame:
        return analytics.top_symbols(self.table("symbol_index"), top_n, repo_id)

    def symbol_history(self, symbol: str, repo_id: str | None = None, fuzzy: bool = False) -> DataFrame:
        return analytics.symbol_history(self.table("commit"), symbol, repo_id, fuzzy)

    def find_related_discussion(self, ref: str, repo_id: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(ref,)], "ref string")
        return links.related_discussion(asked, *(self.table(t) for t in ("commit", "pull_request", "issue", "chunk")), repo_id)

    def graph_topology(self, top_n: int = 20, repo_id: str | None = None) -> dict:
        return graph.topology(graph.tenant_edges(self.table("causal_edges"), repo_id), top_n)

    def blame_explain(self, path: str, file_path: str, first_line: int, last_line: int, repo_id: str = "") -> DataFrame:
        spans = self.spark.createDataFrame([(file_path, first_line, last_line)], "path string, first_line int, last_line int")
        return git_scans.explain_lines(spans, path, self.table("commit"), repo_id)

    def why(self, target: str, path: str = ".", repo_id: str = "") -> DataFrame:
        """The commits behind a line or lines of a file ("file:line", "file:first-last"), as ``blame_explain`` gives them."""
        return self.blame_explain(path, *span_of(target), repo_id)

    def search_history(self, query: str, limit: int = 10, as_of_year: int | None = None, **filters) -> DataFrame:
        at = self.at(self.pinned and self.pinned.number)
        dense = {"vectors": at.table("vector"), "query_vector": list(self.embed([query])[0])} if self.embed else {"vectors": None}
        return search.search_history(at.table("chunk"), query=query, as_of_year=as_of_year or datetime.date.today().year, limit=limit, fitted=at.index().fitted(), **dense, **filters)

    # --- questions --------------------------------------------------------------------------------------------------------

    def plan(self, question: str) -> dict:
        """What is looked for: the question, with hints from the references and symbols that it names; no filter is guessed."""
        texts = self.spark.createDataFrame([(0, question)], "text_id int, text string")
        hints = links.candidate_forensics(texts, *(self.table(t) for t in ("pull_request", "issue", "commit", "symbol_index")))
        return {"query": " ".join(question.split()), "hints": sorted(r.evidence for r in hints.collect()), "filters": {}}

    def evidence(self, question: str, as_of_year: int, limit: int = ANSWER_ROWS, split=None, **filters) -> list:
        """The chunks for a question, up to ``limit`` rows and ANSWER_CHARS characters, with their scores.

        Each sub-question brings what its search finds and what links of the graph lead to from there; pulls and issues that
        the best chunks relate to are added, sub-questions take turns for the first places, and texts are cut to the budget. A
        search that finds nothing is tried again RETRIES times at most, each time without one more of its filters.
        """
        at = self.at(self.pinned and self.pinned.number)
        for _ in range(RETRIES + 1):
            rows = at._retrieved(decompose(question, split), as_of_year, limit, **filters)
            if rows or not filters:
                return rows
            filters.pop(sorted(filters)[-1])
        return []

    def _retrieved(self, questions: list[str], as_of_year: int, limit: int, **filters) -> list:
        chunks, edges = self.table("chunk"), graph.tenant_edges(self.table("causal_edges"), filters.get("repo_id"))
        own = lambda name: self.table(name).where(T.tenant_match(F.col("repo_id"), filters.get("repo_id"), alias=True))
        fitted, parts = self.index().fitted(), []
        allowed = search.filter_chunks(chunks, **filters)
        for i, question in enumerate(questions):
            plan = self.plan(question)["query"]
            dense = {"vectors": self.table("vector"), "query_vectors": [list(self.embed([plan])[0])]} if self.embed else {}
            found = search.search_many(chunks, fitted, [plan], as_of_year, *(self.table(n) for n in ("symbol_index", "pull_request", "issue", "commit")), limit=limit, **dense, **filters)
            found = written(found, "found")
            seeds = found.join(chunks, "id").select("id", "score", F.array_union(graph.chunk_keys(), graph.related_nodes()).alias("refs"))
            linked = graph.follow_links(edges, seeds, allowed).select("id", "score")
            parts.append(found.unionByName(linked).select(F.lit(i).alias("sub_question_idx"), "id", "score"))
        hits = written(reduce(DataFrame.unionByName, parts), "hits")
        best = hits.groupBy("id").agg(F.max("score").alias("score")).join(chunks, "id")
        refs = verify.hydrate(best, own("pull_request"), own("issue"))
        heads = allowed.where(F.col("source_type").isin("pr", "issue")).groupBy(F.concat_ws("#", "source_type", "source_id").alias("ref")).agg(F.min("id").alias("id"))
        hydrated = refs.join(heads, "ref").select(F.lit(0).alias("sub_question_idx"), "id", "score").join(hits.select("id"), "id", "left_anti")
        every = hits.unionByName(hydrated).groupBy("id").agg(F.min_by("sub_question_idx", F.struct(-F.col("score"), "sub_question_idx")).alias("sub_question_idx"), F.max("score").alias("score"))
        placed = written(search.interleave(every).orderBy("pos").limit(limit), "evidence")
        rows = placed.join(chunks, "id")
        lines = search.within_budget(rows.select("pos", F.coalesce("text", F.lit("")).alias("line")), ANSWER_CHARS)
        return rows.drop("text").join(lines.withColumnRenamed("line", "text"), "pos").orderBy("pos").collect()

    def ask(self, question: str, as_of_year: int | None = None, write: Callable[[str, str], str] | None = None, split=None, **filters) -> dict:
        """An answer with its verdict. ``write`` makes a draft of question and evidence; without it the evidence is listed.

        A draft that claims what the tables contradict is written again RETRIES times at most, each time with evidence for
        the claims that could not be verified; what then remains is named in a note.
        """
        at, year, asked, rows = self.at(self.pinned and self.pinned.number), as_of_year or datetime.date.today().year, question, []
        for left in range(RETRIES if write else 0, -1, -1):
            known = {r.id for r in rows}
            rows += [r for r in at.evidence(asked, year, split=split if asked == question else None, **filters) if r.id not in known]
            said = "\n\n".join(r.text or "" for r in rows)
            draft = write(question, said.replace("<evidence", "&lt;evidence").replace("</evidence", "&lt;/evidence")) if write else table_of(rows)
            verdict, notes = at._judged(draft, said, rows)
            if verdict.passed or not left or not notes:
                break
            asked = f"{question} - Address unverified claims: {'; '.join(notes)}"
        related = sorted({x for r in rows[:3] for x in (r.related_ids or []) if x not in draft})
        return {"answer": verify.guardrail(draft, notes, related), "passed": bool(rows) and verdict.passed, "score": verdict.score, "evidence": [r.id for r in rows]}

    def _judged(self, draft: str, said: str, rows: list):
        """(verdict, notes on claims that the tables contradict) of a draft."""
        drafts = self.spark.createDataFrame([(0, draft)], "draft_id int, draft string")
        commits, pulls, issues = (self.table(t) for t in ("commit", "pull_request", "issue"))
        ids = self.spark.createDataFrame([(r.id,) for r in rows], "id string")
        index = verify.evidence_index(commits, self.table("chunk").join(ids, "id", "left_semi"))
        errors = verify.claim_errors(drafts, index, pulls, issues, commits)
        grounded = verify.grounding(drafts, self.spark.createDataFrame([(0, said)], "draft_id int, evidence string"))
        verdict = verify.verdicts(drafts, errors, grounded, verify.citations(drafts, index, pulls, issues, commits)).first()
        return verdict, sorted(r.message for r in errors.collect())


def span_of(target: str) -> tuple[str, int, int]:
    """(file, first line, last line) of "file:line" or "file:first-last"."""
    found = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", target)
    if not found or not 1 <= int(found[2]) <= int(found[3] or found[2]):
        raise ValueError("a target is file:line or file:first-last")
    return found[1], int(found[2]), int(found[3] or found[2])


def table_of(rows: list) -> str:
    """The evidence as a table in Markdown."""

    def cell(text: str | None) -> str:
        said = " ".join((text or "").split()).replace("|", "\\|")
        return said if len(said) <= 160 else said[:161].rsplit(" ", 1)[0]  # a number or a sha that is cut names another

    lines = [f"| {r.source_type} | {r.source_id} | {cell(r.text)} |" for r in rows[:ANSWER_ROWS]]
    return "\n".join(["| type | source | text |", "|---|---|---|", *lines]) if lines else "Nothing was found."


#: The tools by name, with the parameters that a caller may give.
TOOLS = {
    "search_history": ("query", "limit", "repo_id", "source_types", "date_from", "date_to", "file_path"),
    "why": ("target", "path", "repo_id"),
    "blame_explain": ("path", "file_path", "first_line", "last_line", "repo_id"),
    "find_related_discussion": ("ref", "repo_id"),
    "repo_hotspots": ("top_n", "repo_id"),
    "repo_ownership": ("file_path", "repo_id"),
    "change_coupling": ("min_co_commits", "top_n", "repo_id"),
    "repo_symbols": ("top_n", "repo_id"),
    "symbol_history": ("symbol", "repo_id", "fuzzy"),
    "graph_topology": ("top_n", "repo_id"),
    "ask": ("question", "repo_id"),
    "status": (),
}


def call(store: History, tool: str, arguments: dict) -> list | dict:
    """The result of a tool as plain values; what is not a tool or one of its parameters is refused."""
    if tool not in TOOLS:
        raise ValueError(f"no tool named {tool}")
    if unknown := sorted(set(arguments) - set(TOOLS[tool])):
        raise ValueError(f"{tool} takes no {', '.join(unknown)}")
    got = getattr(store.at(), tool)(**arguments)
    return got if isinstance(got, dict) else [json.loads(x) for x in got.toJSON().collect()]
