"""Registered queries of chunks of code, link tables, hydration, timestamps, metrics and pages of a code host."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import chunking, evaluate, links, merge, verify
from annalist.plans.queries import _uuid5, query
from annalist.sources import fixtures as fx, forge


@query(f""", x AS (SELECT 'src/' || o_orderkey || '.py::C' || o_custkey AS source_id, 'class C' || o_custkey || ':' || chr(10) || '    x = 1' AS text FROM orders
 UNION ALL SELECT 'src/' || o_orderkey || '.py::f' || o_orderkey, 'def f' || o_orderkey || '():' || chr(10) || '    return ' || o_orderkey FROM orders)
 SELECT {_uuid5("'r:code:' || source_id || ':0'")} AS id, source_id, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM x""")
def c6_code_chunks(spark, d):
    source = "concat('class C', o_custkey, ':\\n    x = 1\\n\\n\\ndef f', o_orderkey, '():\\n    return ', o_orderkey, '\\n')"
    files = fx.table(spark, d, "orders").selectExpr("'r' AS repo_id", "concat('src/', o_orderkey, '.py') AS file_path", f"{source} AS text")
    return chunking.chunk_code(files).select("id", "source_id", "text", "token_count")


@query("""SELECT repo_id, pr_number, string_agg(issue_number, ',' ORDER BY issue_number) AS linked FROM (SELECT DISTINCT repo_id, pr_number, issue_number FROM (
 SELECT p.repo_id, p.number AS pr_number, i.number AS issue_number FROM p JOIN i ON i.repo_id = p.repo_id AND (i.number = p.number + 1 OR i.number = p.number + 4)
 UNION ALL SELECT i.repo_id, p.number, i.number FROM i JOIN p ON p.repo_id = i.repo_id AND p.number = i.number + 2)) GROUP BY 1, 2""")
def k4_link_arrays(spark, d):
    found = links.link_arrays(links.issue_links(fx.pulls(spark, d), fx.issues(spark, d)), "pr_number", "issue_number", "linked")
    return found.select("repo_id", F.col("pr_number").cast("bigint").alias("pr_number"), F.array_join(F.transform("linked", lambda n: n.cast("string")), ",").alias("linked"))


@query("""SELECT DISTINCT repo_id, pr_number, issue_number FROM (SELECT repo_id, number AS pr_number, number + 1 AS issue_number FROM p UNION ALL SELECT repo_id, number, number + 4 FROM p
 UNION ALL SELECT i.repo_id, p.number, i.number FROM i JOIN p ON p.repo_id = i.repo_id AND p.number = i.number + 2)""")
def k10_links_of_any_number(spark, d):
    found = links.issue_links(fx.pulls(spark, d), fx.issues(spark, d), require_existing=False)
    return found.select("repo_id", F.col("pr_number").cast("bigint").alias("pr_number"), F.col("issue_number").cast("bigint").alias("issue_number"))


@query("SELECT id, false AS embedded FROM ch")
def k9_reset_embeddings(spark, d):
    return merge.reset_embeddings(fx.chunks(spark, d)).select("id", "embedded")


@query(""", t AS (SELECT o_orderkey AS k, 1.0::DOUBLE / (o_orderkey + 2) AS s FROM orders ORDER BY o_orderkey LIMIT 5), r AS (SELECT k AS n, s FROM t UNION ALL SELECT k + 1, s FROM t),
 kn AS (SELECT number AS n, 'pr' AS kind FROM p UNION SELECT number, 'issue' FROM i) SELECT kind || '#' || n AS ref, greatest(0.012::DOUBLE, round_even(0.9 * max(s), 6)) AS score FROM r JOIN kn USING (n) GROUP BY kind, n ORDER BY score DESC, ref LIMIT 3""")
def v1_hydrate(spark, d):
    k = F.col("o_orderkey")
    related = F.array(F.concat(F.lit("pr#"), k.cast("string")), F.concat(F.lit("issue#"), (k + 1).cast("string")))
    chunks = fx.table(spark, d, "orders").select(k.cast("string").alias("id"), (1 / (k + 2)).alias("score"), F.lit("commit").alias("source_type"), F.md5(k.cast("string")).alias("source_id"), related.alias("related_ids"))
    return verify.hydrate(chunks, fx.pulls(spark, d), fx.issues(spark, d))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at FROM orders""")
def f11_lenient_timestamps(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX")).when(k % 4 == 1, day).when(k % 4 == 2, F.concat(day, F.lit(" or so"))).otherwise("none")
    return fx.table(spark, d, "orders").select(k.alias("k"), F.date_format(T.lenient_timestamp(said), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT vec_id AS id, CAST(floor(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])))) * 10000 + 0.5) AS BIGINT) AS score_e4 FROM embeddings")
def f14_clamped_cosine(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(evaluate.clamped_cosine(F.col("embedding"), F.reverse("embedding")) * 10000 + 0.5).alias("score_e4"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, round_even(CASE WHEN l_linenumber % 2 = 0 THEN 0.7 * l_discount + 0.3 * l_tax ELSE l_discount END, 9) AS accuracy FROM lineitem")
def f16_calibrated_accuracy(spark, d):
    accuracy = evaluate.calibrated_accuracy(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") % 2 == 0)
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.bround(accuracy, 9).alias("accuracy"))


@query("SELECT sha FROM c WHERE repo_id = 'ASIA'")
def p1b_tenant_alias(spark, d):
    return fx.commits(spark, d).where(T.tenant_match(F.col("repo_id"), "org/python-Asia", alias=True)).select("sha")


@query("SELECT CAST(o_orderkey AS INT) AS number, n_name AS author, CAST(o_orderkey + 1 AS VARCHAR) AS linked FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def s10_pages_of_pulls(spark, d):
    """Recorded pages of a host, one entry for each order; pages are put together by Spark and read by the connector's parser."""
    k = F.col("o_orderkey")
    entry = F.to_json(F.struct(k.alias("number"), F.lit("t").alias("title"), F.concat(F.lit("Fixes #"), (k + 1).cast("string")).alias("body"), F.struct(F.col("n_name").alias("login")).alias("user"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at")))
    pages = fx.orders(spark, d).select(F.floor(k / forge.PAGE).cast("int").alias("page"), entry.alias("e")).groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ","), F.lit("]")).alias("body"))
    found = forge.rows_of(forge.entries_of(pages), "pulls", "r")
    return found.select("number", "author", F.array_join(F.transform("linked_issue_numbers", lambda n: n.cast("string")), ",").alias("linked"))


@query(""", x AS (SELECT repo_id, sha, unnest([1, 2, 3]) AS o, unnest([k + 1, k + 3, k]) AS number FROM c) SELECT repo_id, sha, arg_min(number, o) AS pr_number FROM x JOIN p USING (repo_id, number) GROUP BY 1, 2""")
def j5_first_pull_of_several_numbers(spark, d):
    """Messages that name three numbers, of which none, one or two are pulls of the repository."""
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    message = F.concat(F.lit("Fixes #"), text(k + 1), F.lit(", after PR "), text(k + 3), F.lit(" (#"), text(k), F.lit(") and #1"))
    commits = fx.orders(spark, d).select(F.col("r_name").alias("repo_id"), F.md5(text(k)).alias("sha"), message.alias("message"))
    return links.pull_of_message(commits, fx.pulls(spark, d)).select("repo_id", "sha", F.col("pr_number").cast("bigint").alias("pr_number"))


@query(""", b AS (SELECT repo_id, sha, k, unnest(['* first change', '- second, PR ' || (k + 1), '• third (#' || k || ')']) AS b FROM c)
 SELECT sha AS source_id, 'Commit ' || left(sha, 7) || ': ' || b AS text, 'pr#' || (k + 1) || ',pr#' || k AS related FROM b""")
def c3_bullets_of_commits(spark, d):
    """Squashed commits: a chunk for each bullet, related to what the message names."""
    k = F.regexp_extract("message", r"Order (-?\d+)", 1).cast("bigint") + F.when(F.col("is_revert"), 7).otherwise(0)
    text = lambda x: x.cast("string")
    said = F.concat(F.lit("Squash\n\n* first change\n- second, PR "), text(k + 1), F.lit("\n  • third (#"), text(k), F.lit(")\nend"))
    chunks = chunking.chunk_commits(fx.commits(spark, d).withColumn("message", said))
    parts = chunks.where(F.startswith("text", F.concat(F.lit("Commit "), F.left("source_id", F.lit(7)), F.lit(": "))))
    return parts.select("source_id", "text", F.array_join("related_ids", ",").alias("related"))
