"""The history model over the order tables that the driver supplies: orders are commits, line items touched files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sha(key):
    return F.md5(key.cast("string"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the nation and region of their customer."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n, r = table(spark, d, "nation"), table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return o.join(c, "o_custkey").join(F.broadcast(n), "n_nationkey").join(F.broadcast(r), "n_regionkey")


def commits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    author = F.when(k % 10 < 7, "lead").otherwise(F.col("n_name"))
    undone = F.concat(F.lit('Revert "Order '), (k - 7).cast("string"), F.lit('"'))
    named = F.concat(F.lit("\n\nThis reverts commit "), _sha(k - 7), F.lit("."))
    plain = F.concat(F.lit("Order "), k.cast("string"), F.lit("\n\nFixes #"), (k % 50).cast("string"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("_i"))
    path = lambda x: F.concat(F.lit("supp/"), x["l_suppkey"].cast("string"))
    none = F.array().cast("array<string>")
    return orders(spark, d).join(items, "o_orderkey", "left").select(
        F.col("r_name").alias("repo_id"), _sha(k).alias("sha"), author.alias("author_name"), F.concat(F.lower(F.translate(author, " ", ".")), F.lit("@example.org")).alias("author_email"),
        F.col("o_orderdate").alias("authored_date"), F.when(k % 14 == 0, F.concat(undone, named)).when(k % 7 == 0, undone).otherwise(plain).alias("message"),
        F.coalesce(F.transform("_i", path), none).alias("files_changed"),
        F.coalesce(F.array_distinct(F.transform("_i", lambda x: F.concat(path(x), F.lit("::part"), (x["l_partkey"] % 50).cast("string")))), none).alias("symbols_modified"),
        F.coalesce(F.size("_i"), F.lit(0)).alias("insertions"), F.lit(0).alias("deletions"), (k % 7 == 0).alias("is_revert"), F.lit(None).cast("string").alias("reverts_sha"), F.lit(None).cast("string").alias("superseded_by_sha"), F.lit(None).cast("string").alias("diff_summary"),
    )


def pulls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    return orders(spark, d).where(k % 3 == 0).select(
        F.col("r_name").alias("repo_id"), k.cast("int").alias("number"), F.concat(F.lit("PR "), s(k)).alias("title"), F.concat(F.lit("Fixes #"), s(k + 1), F.lit(" and see #"), s(k + 4), F.lit(".")).alias("body"),
        F.lit("merged").alias("state"), F.col("n_name").alias("author"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("merged_at"), _sha(k).alias("merge_commit_sha"),
        F.array().cast("array<int>").alias("linked_issue_numbers"), F.array(F.left(_sha(k + 3), F.lit(8))).alias("linked_commit_shas"),
    )


def issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, d).where(k % 3 == 1).select(
        F.col("r_name").alias("repo_id"), k.cast("int").alias("number"), F.concat(F.lit("Issue "), k.cast("string")).alias("title"), F.concat(F.lit("Broken by #"), (k + 2).cast("string"), F.lit(".")).alias("body"),
        F.lit("closed").alias("state"), F.col("n_name").alias("author"), F.col("o_orderdate").alias("created_at"), F.array().cast("array<int>").alias("linked_pr_numbers"), F.array().cast("array<string>").alias("linked_commit_shas"),
    )


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols_of(commits(spark, d))


def symbols_of(commits: DataFrame) -> DataFrame:
    rows = commits.select("repo_id", F.explode("symbols_modified").alias("symbol_id")).distinct()
    return rows.select("repo_id", "symbol_id", F.substring_index("symbol_id", "::", 1).alias("file_path"), F.substring_index("symbol_id", "::", -1).alias("symbol_name"), F.lit("function").alias("kind"))


TYPES = ("commit", "pr", "issue", "code", "file")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    return table(spark, d, "documents").select(
        i.cast("string").alias("id"), F.col("lang").alias("repo_id"), F.element_at(F.array(*map(F.lit, TYPES)), (i % 5 + 1).cast("int")).alias("source_type"), i.cast("string").alias("source_id"), "text",
        F.timestamp_add("DAY", (i % 5000).cast("int"), F.lit("2010-01-01").cast("timestamp")).alias("timestamp"), F.array(F.concat("source", F.lit("/file"), (i % 40).cast("string"), F.lit(".py"))).alias("file_paths"),
        F.array(F.concat(F.lit("mod::name"), (i % 30).cast("string"))).alias("symbols_modified"), none.alias("related_ids"), (i % 11 == 0).alias("is_reverted"), F.ceil(F.length("text") / 4).cast("int").alias("token_count"), (i % 2 == 0).alias("embedded"),
    )


def place_edges(spark: SparkSession, d: str, suppliers_only: bool = False) -> DataFrame:
    """region -> nation -> customer -> order (or supplier) as typed edges."""
    n, c, o, s = (table(spark, d, t) for t in ("nation", "customer", "orders", "supplier"))
    node = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    edge = lambda df, a, b, kind: df.select(F.lit("").alias("repo_id"), a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(kind.upper()).alias("label"), F.lit(False).alias("highlight"))
    out = edge(n, node("region", "n_regionkey"), node("nation", "n_nationkey"), "holds")
    if suppliers_only:
        return out.unionByName(edge(s, node("nation", "s_nationkey"), node("supplier", "s_suppkey"), "holds")).unionByName(edge(s.where("s_suppkey % 3 = 0"), node("supplier", "s_suppkey"), node("region", "s_nationkey"), "serves"))
    return out.unionByName(edge(c, node("nation", "c_nationkey"), node("customer", "c_custkey"), "holds")).unionByName(edge(o, node("customer", "o_custkey"), node("order", "o_orderkey"), "places"))
