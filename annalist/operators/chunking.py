"""Row generators that cut history records into text chunks with deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import code
from annalist.functions.text import pulls_in_message, token_count, truncate_tokens, uuid5_url

# fixed values: token limits of the chunkers
COMMIT_LIMIT, COMMIT_BODY, COMMIT_HARD, PART_TOKENS = 500, 350, 520, 350
BULLET = r"^(?:\* |- |• )"
SLICE_CHARS = 3000
MAX_SYMBOLS = 40


def chunk_id(repo: Column, kind: Column, source: Column, index: Column) -> Column:
    """Depends on the place, not on the text."""
    return uuid5_url(F.concat_ws(":", F.coalesce(repo, F.lit("")), kind, source, index.cast("string")))


def _finish(df: DataFrame, kind: str, source: Column, paths: Column, symbols: Column, related: Column, reverted: Column, at: Column) -> DataFrame:
    k = F.lit(kind)
    return df.select(
        chunk_id(F.col("repo_id"), k, source, F.col("index")).alias("id"), "repo_id", k.alias("source_type"), source.alias("source_id"), "text", at.cast("timestamp").alias("timestamp"),
        F.coalesce(paths, F.array().cast("array<string>")).alias("file_paths"), F.coalesce(symbols, F.array().cast("array<string>")).alias("symbols_modified"),
        F.coalesce(related, F.array().cast("array<string>")).alias("related_ids"), reverted.alias("is_reverted"), token_count(F.col("text")).alias("token_count"), F.lit(False).alias("embedded"),
    )


def chunk_commits(commits: DataFrame, pulls_of_commits: DataFrame | None = None) -> DataFrame:
    """A chunk per commit, and one per bullet of its message, or else per further paragraph of a long one.

    They relate to the pull that brought the commit (repo_id, sha, pr_number), where it is given, and to what the message names
    as one.
    """
    static = F.concat_ws(
        "\n", F.concat(F.lit("Commit "), F.left("sha", F.lit(7)), F.lit(" by "), F.coalesce("author_name", F.lit("unknown"))),
        F.when(F.size("symbols_modified") > 0, F.concat(F.lit("Symbols: "), F.array_join(F.slice("symbols_modified", 1, 10), ", "))),
        F.when(F.col("reverts_sha").isNotNull(), F.concat(F.lit("Reverts: "), F.left("reverts_sha", F.lit(7)))),
        F.when(F.col("superseded_by_sha").isNotNull(), F.concat(F.lit("Superseded by: "), F.left("superseded_by_sha", F.lit(7)))),
    )
    own = commits.withColumn("_pulls", pulls_in_message(F.col("message")))
    if pulls_of_commits is not None:
        own = own.join(pulls_of_commits.select("repo_id", "sha", F.col("pr_number").alias("_own")), ["repo_id", "sha"], "left")
        own = own.withColumn("_pulls", F.array_distinct(F.array_compact(F.concat(F.array("_own"), "_pulls"))))
    base = own.withColumns({"_head": static, "_message": F.coalesce("message", F.lit("")), "_diff": F.coalesce("diff_summary", F.lit(""))})
    whole = F.concat_ws("\n", "_head", "_message", F.nullif("_diff", F.lit("")))
    cut_message = F.expr(f"substring(_message, 1, 4 * greatest({COMMIT_BODY} - cast(ceil(length(_head) / 4) as int), 100))")
    long = token_count(whole) > COMMIT_LIMIT
    base = base.withColumns({"_m": F.when(long, cut_message).otherwise(F.col("_message")), "_long": long})
    body = F.expr(f"substring(_diff, 1, 4 * greatest({COMMIT_LIMIT} - cast(ceil(length(_m) / 4) as int), 50))")
    text = F.concat_ws("\n", "_head", "_m", F.nullif(F.when(F.col("_long"), body).otherwise(F.col("_diff")), F.lit("")))
    text = F.when(token_count(text) > COMMIT_HARD, truncate_tokens(text, COMMIT_LIMIT)).otherwise(text)
    bullets = F.filter(F.transform(F.split("_m", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(BULLET) & (F.length(x) > 5))
    paragraphs = F.filter(F.slice(F.split("_m", "\n\n"), 2, 1000000), lambda x: F.length(F.trim(x)) > 20)
    parts = F.when(F.size(bullets) > 0, bullets).when(token_count(F.col("_message")) > 250, paragraphs).otherwise(F.array().cast("array<string>"))
    subs = F.transform(parts, lambda x: F.when(token_count(x) > 400, truncate_tokens(x, PART_TOKENS)).otherwise(x))
    head = F.concat(F.lit("Commit "), F.left("sha", F.lit(7)), F.lit(": "))
    texts = F.concat(F.array(text), F.transform(subs, lambda x: F.concat(head, x)))
    rows = base.select("*", F.posexplode(texts).alias("index", "text"))
    related = F.transform("_pulls", lambda n: F.concat(F.lit("pr#"), n.cast("string")))
    related = F.concat(related, F.array_compact(F.array(F.when(F.col("reverts_sha").isNotNull(), F.concat(F.lit("commit#"), "reverts_sha")), F.when(F.col("superseded_by_sha").isNotNull(), F.concat(F.lit("commit#"), "superseded_by_sha")))))
    return _finish(rows, "commit", F.col("sha"), F.col("files_changed"), F.col("symbols_modified"), related, F.col("superseded_by_sha").isNotNull(), F.col("authored_date"))


def _comments(column: str, with_place: bool) -> Column:
    place = lambda c: F.when(c["path"].isNotNull(), F.concat(F.lit(" on "), c["path"], F.lit(":"), F.coalesce(c["line"].cast("string"), F.lit("?")))).otherwise("")
    line = lambda c: F.concat(F.lit("Comment by "), F.coalesce(c["author"], c["user"], F.lit("unknown")), place(c) if with_place else F.lit(""), F.lit(": "), truncate_tokens(F.coalesce(c["body"], F.lit("")), PART_TOKENS))
    return F.coalesce(F.transform(column, line), F.array().cast("array<string>"))


def _head(kind: str) -> Column:
    title = F.concat(F.lit(f"{kind} #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")))
    body = F.coalesce("body", F.lit(""))
    return F.concat_ws("\n", title, F.when(token_count(F.concat_ws("\n", title, body)) > 400, truncate_tokens(body, 300)).otherwise(body))


def chunk_issues(issues: DataFrame) -> DataFrame:
    rows = issues.select("*", F.posexplode(F.concat(F.array(_head("Issue")), _comments("comments", False))).alias("index", "text"))
    related = F.concat(F.transform("linked_pr_numbers", lambda n: F.concat(F.lit("pr#"), n.cast("string"))), F.transform("linked_commit_shas", lambda s: F.concat(F.lit("commit#"), s)))
    none = F.array().cast("array<string>")
    return _finish(rows, "issue", F.col("number").cast("string"), none, none, related, F.lit(False), F.col("created_at"))


def chunk_pulls(pulls: DataFrame) -> DataFrame:
    """Head, review comments with their places, comments: one running index."""
    rows = pulls.select("*", F.posexplode(F.concat(F.array(_head("PR")), _comments("review_comments", True), _comments("comments", False))).alias("index", "text"))
    related = F.concat(F.transform("linked_issue_numbers", lambda n: F.concat(F.lit("issue#"), n.cast("string"))), F.transform("linked_commit_shas", lambda s: F.concat(F.lit("commit#"), s)))
    none = F.array().cast("array<string>")
    return _finish(rows, "pr", F.col("number").cast("string"), none, none, related, F.lit(False), F.coalesce("merged_at", "created_at"))


def chunk_files(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Slices of SLICE_CHARS characters of ``files`` (repo_id, file_path, text); Python files give the first slice only.

    The first slice begins with the symbols that the file defines, if they are known.
    """
    n = F.greatest(F.ceil(F.length("text") / SLICE_CHARS).cast("int"), F.lit(1))
    n = F.when(F.endswith("file_path", F.lit(".py")), 1).otherwise(n)
    rows = files.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    rows = rows.withColumn("text", F.expr(f"substring(text, index * {SLICE_CHARS} + 1, {SLICE_CHARS})"))
    if symbols is not None:
        named = symbols.groupBy("repo_id", "file_path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("symbol_name")), 1, MAX_SYMBOLS), ", ").alias("_s"))
        rows = rows.join(named, ["repo_id", "file_path"], "left")
        rows = rows.withColumn("text", F.when((F.col("index") == 0) & F.col("_s").isNotNull(), F.concat(F.lit("Defined Symbols: "), "_s", F.lit("\n"), "text")).otherwise(F.col("text")))
    none = F.array().cast("array<string>")
    return _finish(rows, "file", F.col("file_path"), F.array("file_path"), none, none, F.lit(False), F.lit(None))


def chunk_code(files: DataFrame) -> DataFrame:
    """The definitions of the Python files among ``files`` (repo_id, file_path, text), a chunk for each."""
    rows = code.with_chunks(files.where(F.endswith("file_path", F.lit(".py")))).withColumn("index", F.lit(0))
    none = F.array().cast("array<string>")
    return _finish(rows, "code", F.col("symbol_id"), F.array("file_path"), F.array("symbol_id"), none, F.lit(False), F.lit(None))


def footprint(commits: DataFrame, pulls_of_commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(repo_id, sha, diff_summary): files, line counts, symbols, and the pull that brought the commit."""
    more = F.when(F.size("files_changed") > 5, F.concat(F.lit(" (+"), (F.size("files_changed") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    files = F.concat(
        F.lit("Files modified ("), F.size("files_changed").cast("string"), F.lit("): "), F.array_join(F.slice("files_changed", 1, 5), ", "), more,
        F.lit(" (+"), F.coalesce("insertions", F.lit(0)).cast("string"), F.lit("/-"), F.coalesce("deletions", F.lit(0)).cast("string"), F.lit(" lines)"),
    )
    others = F.when(F.size("symbols_modified") > 10, F.concat(F.lit(" (+"), (F.size("symbols_modified") - 10).cast("string"), F.lit(" more)"))).otherwise("")
    symbols = F.when(F.size("symbols_modified") > 0, F.concat(F.lit("Symbols: "), F.array_join(F.slice("symbols_modified", 1, 10), ", "), others))
    joined = commits.join(pulls_of_commits, ["repo_id", "sha"], "left").join(pulls.select("repo_id", F.col("number").alias("pr_number"), "title", "body"), ["repo_id", "pr_number"], "left")
    pull = F.when(F.col("pr_number").isNotNull(), F.concat(F.lit("PR #"), F.col("pr_number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" "), F.left(F.coalesce("body", F.lit("")), F.lit(200))))
    return joined.select("repo_id", "sha", F.concat_ws("\n", files, symbols, pull).alias("diff_summary"))
