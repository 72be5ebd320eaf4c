"""Change analytics over commits. Every result has a total order: counts descending, then the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.functions.text import first_line, tenant_match


def scoped(df: DataFrame, repo_id: str | None) -> DataFrame:
    return df.where(tenant_match(F.col("repo_id"), repo_id))


def hotspots(commits: DataFrame, top_n: int = 15, repo_id: str | None = None) -> DataFrame:
    """Files by number of touches."""
    files = scoped(commits, repo_id).select(F.explode("files_changed").alias("file_path"))
    return files.groupBy("file_path").agg(F.count(F.lit(1)).alias("commit_count")).orderBy(F.desc("commit_count"), "file_path").limit(top_n)


def _authors(commits: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.trim("author_email"), F.lit("")), F.nullif(F.trim("author_name"), F.lit("")), F.lit("unknown"))
    return commits.withColumn("author_key", key)


def ownership(commits: DataFrame, file_path: str | None = None, repo_id: str | None = None, threshold: float = 60.0) -> DataFrame:
    """Commits by author; identities with one key, then with one display name, are merged. Risk is HIGH over the threshold."""
    rows = _authors(scoped(commits, repo_id))
    if file_path:
        rows = rows.where(F.array_contains("files_changed", file_path))
    by_key = rows.groupBy("author_key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.nullif(F.trim("author_name"), F.lit("")), F.struct("authored_date", "sha")).alias("name"))
    named = by_key.withColumn("author", F.coalesce("name", "author_key"))
    email = F.min(F.when(F.contains("author_key", F.lit("@")), F.col("author_key")))
    by_name = named.groupBy("author").agg(F.sum("n").alias("commit_count"), email.alias("email"))
    total = by_name.agg(F.sum("commit_count").alias("total"))  # one row
    out = by_name.crossJoin(F.broadcast(total)).withColumn("percentage", F.bround(100 * F.col("commit_count") / F.col("total"), 2))
    top = out.agg(F.max("percentage").alias("top"))  # one row
    return out.crossJoin(F.broadcast(top)).select("author", "email", "commit_count", "percentage", F.when(F.col("top") > threshold, "HIGH").otherwise("NORMAL").alias("bus_factor_risk"))


def file_owners(commits: DataFrame, top_n: int = 20, repo_id: str | None = None, threshold: float = 60.0) -> DataFrame:
    """The most touched files with their main author."""
    touches = _authors(scoped(commits, repo_id)).select(F.explode("files_changed").alias("file_path"), "author_key")
    counts = touches.groupBy("file_path", "author_key").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("file_path").agg(F.sum("n").alias("total_commits"), F.min(F.struct((-F.col("n")).alias("m"), "author_key")).alias("t"))
    top = best.orderBy(F.desc("total_commits"), "file_path").limit(top_n)
    pct = F.bround(-100 * F.col("t.m") / F.col("total_commits"), 2)
    return top.select("file_path", "total_commits", F.col("t.author_key").alias("top_author"), pct.alias("percentage"), F.when(pct > threshold, "HIGH").otherwise("NORMAL").alias("risk"))


def change_coupling(commits: DataFrame, min_co_commits: int = 2, top_n: int = 15, repo_id: str | None = None, max_files: int = 25) -> DataFrame:
    """File pairs by commits that touch both. Commits of one file or of more than ``max_files`` say nothing."""
    sets = scoped(commits, repo_id).select(F.array_sort(F.array_distinct("files_changed")).alias("f")).where(F.size("f").between(2, max_files))
    pairs = sets.select(F.posexplode("f").alias("i", "file_a"), "f").select("file_a", F.explode(F.slice("f", F.col("i") + 2, F.lit(max_files))).alias("file_b"))
    counts = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_commit_count")).where(F.col("co_commit_count") >= min_co_commits)
    return counts.orderBy(F.desc("co_commit_count"), "file_a", "file_b").limit(top_n)


def symbol_counts(commits: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols`` (repo_id, symbol_id, ...) with the number of commits that touch each."""
    touched = commits.select("repo_id", "sha", F.explode("symbols_modified").alias("symbol_id")).groupBy("repo_id", "symbol_id").agg(F.countDistinct("sha").alias("commit_count"))
    return symbols.drop("commit_count").join(touched, ["repo_id", "symbol_id"], "left").fillna(0, ["commit_count"])


def top_symbols(symbols: DataFrame, top_n: int = 20, repo_id: str | None = None) -> DataFrame:
    return scoped(symbols, repo_id).orderBy(F.desc("commit_count"), "symbol_id", "repo_id").limit(top_n)


def symbol_history(commits: DataFrame, query: str, repo_id: str | None = None, fuzzy: bool = False) -> DataFrame:
    """Commits that touch a symbol: its full id, its last segment, or (fuzzy) any part of the id; ignoring case."""
    q = query.lower()

    def fits(s):
        s = F.lower(s)
        return F.contains(s, F.lit(q)) if fuzzy else (s == q) | F.endswith(s, F.lit(f"::{q}")) | (F.element_at(F.split(s, ":"), -1) == q)

    hits = F.filter("symbols_modified", fits)
    return scoped(commits, repo_id).where(F.size(hits) > 0).select("sha", "authored_date", first_line(F.col("message")).alias("subject"), F.array_join(F.array_sort(hits), ",").alias("symbols")).orderBy("authored_date", "sha")


def symbol_multiplicity(symbols: DataFrame) -> DataFrame:
    """How often each bare name occurs; a unique one may name its node."""
    return symbols.select("repo_id", "symbol_id", "symbol_name", F.count(F.lit(1)).over(W.partitionBy("repo_id", "symbol_name")).alias("multiplicity"))


def status(**tables: DataFrame) -> DataFrame:
    """(table, rows, embedded_percent): one pass over each table; the share is of chunks only."""
    out = None
    for name, df in sorted(tables.items()):
        share = F.bround(100 * F.count_if("embedded") / F.nullif(F.count(F.lit(1)), F.lit(0)), 1) if "embedded" in df.columns else F.lit(None).cast("double")
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), share.alias("embedded_percent"))
        out = row if out is None else out.unionByName(row)
    return out


def linked_ratio(commits: DataFrame, pulls_of_commits: DataFrame) -> DataFrame:
    linked = commits.select("sha").join(pulls_of_commits.select("sha").distinct().withColumn("_l", F.lit(True)), "sha", "left")
    return linked.agg(F.count_if(F.col("_l")).alias("linked"), F.count(F.lit(1)).alias("total"))


def distinct_repos(commits: DataFrame) -> DataFrame:
    return commits.agg(F.countDistinct("repo_id").alias("repos"))


def mean_metrics(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The arithmetic mean of every numeric column of evaluation results, in all or by key."""
    names = [f.name for f in results.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short") and f.name not in by]
    return results.groupBy(*by).agg(*(F.avg(n).alias(n) for n in names))
