"""The registered queries over the fixture tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.functions import code, text as T
from annalist.operators import analytics, centrality, chunking, evaluate, graph, links, merge, search, verify
from annalist.sources import fixtures as fx, history
from annalist.storage import written

QUERIES: dict = {}


def _uuid5(key: str) -> str:
    """SQL of the uuid5 of ``key`` in the URL namespace."""
    h = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({key}))"
    part = lambda a, n: f"substr({h}, {a}, {n})"
    variant = f"substr('89ab', (strpos('0123456789abcdef', {part(17, 1)}) - 1) % 4 + 1, 1)"
    return f"{part(1, 8)} || '-' || {part(9, 4)} || '-5' || {part(14, 3)} || '-' || {variant} || {part(18, 3)} || '-' || {part(21, 12)}"


ORACLE_SQL: dict[str, str] = {}

_C = """WITH c AS (SELECT o.o_orderkey AS k, md5(CAST(o.o_orderkey AS VARCHAR)) AS sha, r.r_name AS repo_id,
 CASE WHEN o.o_orderkey % 10 < 7 THEN 'lead' ELSE n.n_name END AS author, n.n_name AS nation, o.o_orderdate AS d,
 CASE WHEN o.o_orderkey % 7 = 0 THEN 'Revert "Order ' || (o.o_orderkey - 7) || '"' ELSE 'Order ' || o.o_orderkey END AS subject,
 CASE WHEN o.o_orderkey % 14 = 0 THEN md5(CAST(o.o_orderkey - 7 AS VARCHAR)) END AS named
 FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
 cf AS (SELECT c.*, 'supp/' || l_suppkey AS f, 'supp/' || l_suppkey || '::part' || (l_partkey % 50) AS s, 'part' || (l_partkey % 50) AS sn FROM c JOIN lineitem ON l_orderkey = k),
 p AS (SELECT repo_id, k AS number, sha AS merge_sha, left(md5(CAST(k + 3 AS VARCHAR)), 8) AS ref FROM c WHERE k % 3 = 0),
 i AS (SELECT repo_id, k AS number FROM c WHERE k % 3 = 1),
 e AS (SELECT 'region:' || n_regionkey AS a, 'nation:' || n_nationkey AS b, 'holds' AS t FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'holds' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'places' FROM orders),
 es AS (SELECT 'region:' || n_regionkey AS a, 'nation:' || n_nationkey AS b FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0),
 ch AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang AS repo_id, ['commit', 'pr', 'issue', 'code', 'file'][doc_id % 5 + 1] AS source_type, text, TIMESTAMP '2010-01-01' + to_days(CAST(doc_id % 5000 AS INT)) AS ts,
  source || '/file' || (doc_id % 40) || '.py' AS path, 'mod::name' || (doc_id % 30) AS sym, doc_id % 11 = 0 AS reverted, doc_id % 2 = 0 AS embedded FROM documents)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = _C + sql
        return f

    return add


# --- analytics -------------------------------------------------------------------------------------------------


@query("SELECT f AS file_path, count(*) AS commit_count FROM cf GROUP BY f ORDER BY commit_count DESC, file_path LIMIT 15")
def a1_hotspots(spark, d):
    return analytics.hotspots(fx.commits(spark, d))


@query("SELECT f AS file_path, count(*) AS commit_count FROM cf WHERE repo_id = 'ASIA' GROUP BY f ORDER BY commit_count DESC, file_path LIMIT 15")
def a1_hotspots_tenant(spark, d):
    return analytics.hotspots(fx.commits(spark, d), repo_id="org/Asia")


@query(""", x AS (SELECT author, count(*) AS n FROM c GROUP BY author)
 SELECT author, lower(replace(author, ' ', '.')) || '@example.org' AS email, n AS commit_count, round_even(100 * n / sum(n) OVER (), 2) AS percentage,
 CASE WHEN max(round_even(100 * n / (SELECT sum(n) FROM x), 2)) OVER () > 60 THEN 'HIGH' ELSE 'NORMAL' END AS bus_factor_risk FROM x""")
def a2_ownership(spark, d):
    return analytics.ownership(fx.commits(spark, d))


@query(""", x AS (SELECT author, count(*) AS n FROM (SELECT DISTINCT sha, author FROM cf WHERE f = 'supp/1') GROUP BY author)
 SELECT author, lower(replace(author, ' ', '.')) || '@example.org' AS email, n AS commit_count, round_even(100 * n / sum(n) OVER (), 2) AS percentage,
 CASE WHEN max(round_even(100 * n / (SELECT sum(n) FROM x), 2)) OVER () > 60 THEN 'HIGH' ELSE 'NORMAL' END AS bus_factor_risk FROM x""")
def a2_ownership_of_file(spark, d):
    return analytics.ownership(fx.commits(spark, d), file_path="supp/1")


@query(""", x AS (SELECT f, lower(replace(author, ' ', '.')) || '@example.org' AS a, count(*) AS n FROM cf GROUP BY 1, 2), y AS (SELECT *, sum(n) OVER (PARTITION BY f) AS t, row_number() OVER (PARTITION BY f ORDER BY n DESC, a) AS r FROM x)
 SELECT f AS file_path, CAST(t AS BIGINT) AS total_commits, a AS top_author, round_even(100 * n / t, 2) AS percentage, CASE WHEN round_even(100 * n / t, 2) > 60 THEN 'HIGH' ELSE 'NORMAL' END AS risk FROM y WHERE r = 1 ORDER BY t DESC, f LIMIT 20""")
def a3_file_owners(spark, d):
    return analytics.file_owners(fx.commits(spark, d))


@query(""", x AS (SELECT DISTINCT sha, f FROM cf) SELECT a.f AS file_a, b.f AS file_b, count(*) AS co_commit_count FROM x a JOIN x b ON a.sha = b.sha AND a.f < b.f
 WHERE a.sha IN (SELECT sha FROM x GROUP BY sha HAVING count(*) BETWEEN 2 AND 25) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""")
def a4_change_coupling(spark, d):
    return analytics.change_coupling(fx.commits(spark, d))


@query("SELECT repo_id, s AS symbol_id, count(DISTINCT sha) AS commit_count FROM cf GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 20")
def a5_top_symbols(spark, d):
    return analytics.top_symbols(analytics.symbol_counts(fx.commits(spark, d), fx.symbols(spark, d))).select("repo_id", "symbol_id", "commit_count")


@query("SELECT repo_id, s AS symbol_id, count(DISTINCT sha) AS commit_count FROM cf GROUP BY 1, 2")
def a7_symbol_counts(spark, d):
    return analytics.symbol_counts(fx.commits(spark, d), fx.symbols(spark, d)).select("repo_id", "symbol_id", "commit_count")


@query("SELECT sha, subject, string_agg(DISTINCT s, ',' ORDER BY s) AS symbols FROM cf WHERE sn = 'part7' GROUP BY 1, 2")
def a6_symbol_history(spark, d):
    return analytics.symbol_history(fx.commits(spark, d), "part7").drop("authored_date")


@query("SELECT sha, subject, string_agg(DISTINCT s, ',' ORDER BY s) AS symbols FROM cf WHERE s LIKE '%part1%' GROUP BY 1, 2")
def a6_symbol_history_fuzzy(spark, d):
    return analytics.symbol_history(fx.commits(spark, d), "part1", fuzzy=True).drop("authored_date")


@query("SELECT 'chunk' AS table_name, count(*) AS n_rows, round_even(100 * count(*) FILTER (embedded) / count(*), 1) AS embedded_percent FROM ch UNION ALL SELECT 'commit', count(*), NULL FROM c UNION ALL SELECT 'issue', count(*), NULL FROM i UNION ALL SELECT 'pull_request', count(*), NULL FROM p")
def a8_status(spark, d):
    return analytics.status(commit=fx.commits(spark, d), pull_request=fx.pulls(spark, d), issue=fx.issues(spark, d), chunk=fx.chunks(spark, d))


@query("SELECT count(DISTINCT repo_id) AS repos FROM c")
def a9_distinct_repos(spark, d):
    return analytics.distinct_repos(fx.commits(spark, d))


@query(", x AS (SELECT DISTINCT repo_id, s, sn FROM cf) SELECT repo_id, s AS symbol_id, sn AS symbol_name, count(*) OVER (PARTITION BY repo_id, sn) AS multiplicity FROM x")
def a10_symbol_multiplicity(spark, d):
    return analytics.symbol_multiplicity(fx.symbols(spark, d))


@query("SELECT count(DISTINCT c.sha) FILTER (p.number IS NOT NULL) AS linked, count(DISTINCT c.sha) AS total FROM c LEFT JOIN p ON p.repo_id = c.repo_id AND (starts_with(c.sha, p.ref) OR c.sha = p.merge_sha)")
def a11_linked_ratio(spark, d):
    c = fx.commits(spark, d)
    return analytics.linked_ratio(c, links.pull_of_commit(fx.pulls(spark, d), c))


# --- filters and projections -------------------------------------------------------------------------------------


@query("SELECT id FROM ch WHERE repo_id = 'en' AND source_type IN ('commit', 'code') AND NOT reverted AND ts >= TIMESTAMP '2010-03-01' AND ts < TIMESTAMP '2012-01-01' AND path LIKE '%file1%'")
def p_filtered_chunks(spark, d):
    return search.filter_chunks(fx.chunks(spark, d), "x/EN", ["commit", "code"], False, "FILE1", "2010-03-01", "2011-12-31").select("id")


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-06'")
def p2_time_range(spark, d):
    return fx.table(spark, d, "events").where(T.time_range(F.col("ts"), "2024-01-02", "2024-01-05")).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT sha FROM c WHERE k % 7 = 0")
def p10_reverts(spark, d):
    return fx.commits(spark, d).where(T.is_revert(F.col("message"))).select("sha")


# each text that holds nothing to be taken out, with what is taken out before and behind it
_PLAIN = r"(?i)\b(repo|is|owner|org|site|author|label):\S|git\s+log|--(grep|oneline|author|since|until|path|name-only|stat)|(^|[\s\"'])-+($|[\s\"'])"
_PLAIN_SQL = _PLAIN.replace("'", "''")


@query(rf"""SELECT id, 'why ' || trim(regexp_replace(translate(text, '"''', '  '), '[ \t\n\v\f\r]+', ' ', 'g')) || ' retry x-y' AS q FROM ch WHERE trim(text) <> '' AND NOT regexp_matches(text, '{_PLAIN_SQL}')""")
def p13_sanitize_query(spark, d):
    texts = fx.chunks(spark, d).where((F.trim("text") != "") & ~F.col("text").rlike(_PLAIN))
    asked = F.concat(F.lit('why owner:psf ORG:x "site:y " '), "text", F.lit(" --since=2024 git  log 'retry' - -- x-y is:open label:a,b"))
    return texts.select("id", T.sanitize_query(asked).alias("q"))


# --- links ---------------------------------------------------------------------------------------------------------


@query("SELECT sha FROM c WHERE k % 4 != 0")
def j1_new_commits(spark, d):
    c = fx.commits(spark, d)
    known = fx.orders(spark, d).where("o_orderkey % 4 = 0").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha"))
    return links.new_rows(c, known, ["sha"]).select("sha")


@query("""SELECT DISTINCT repo_id, pr_number, issue_number FROM (SELECT p.repo_id, p.number AS pr_number, i.number AS issue_number FROM p JOIN i ON i.repo_id = p.repo_id AND (i.number = p.number + 1 OR i.number = p.number + 4)
 UNION ALL SELECT i.repo_id, p.number, i.number FROM i JOIN p ON p.repo_id = i.repo_id AND p.number = i.number + 2) x""")
def j3_issue_links(spark, d):
    return links.issue_links(fx.pulls(spark, d), fx.issues(spark, d)).select("repo_id", F.col("pr_number").cast("bigint").alias("pr_number"), F.col("issue_number").cast("bigint").alias("issue_number"))


@query("SELECT c.repo_id, c.sha, max(p.number) AS pr_number FROM c JOIN p ON p.repo_id = c.repo_id AND (starts_with(c.sha, p.ref) OR c.sha = p.merge_sha) GROUP BY 1, 2")
def j4_pull_of_commit(spark, d):
    return links.pull_of_commit(fx.pulls(spark, d), fx.commits(spark, d)).select("repo_id", "sha", F.col("pr_number").cast("bigint").alias("pr_number"))


@query("SELECT c.repo_id, c.sha, p.number AS pr_number FROM c JOIN p ON p.repo_id = c.repo_id AND p.number = c.k % 50 WHERE c.k % 7 != 0")
def j5_pull_of_message(spark, d):
    return links.pull_of_message(fx.commits(spark, d), fx.pulls(spark, d)).select("repo_id", "sha", F.col("pr_number").cast("bigint").alias("pr_number"))


@query(""", r AS (SELECT repo_id, sha, d, named, 'Order ' || (k - 7) AS want FROM c WHERE k % 7 = 0), s AS (SELECT r.repo_id, r.sha, arg_max(c.sha, (c.d, c.sha)) AS o FROM r JOIN c ON c.repo_id = r.repo_id AND c.subject = r.want AND c.d < r.d GROUP BY 1, 2)
 SELECT r.repo_id, r.sha, coalesce(n.sha, s.o) AS reverts_sha, CASE WHEN n.sha IS NOT NULL THEN 'sha' WHEN s.o IS NOT NULL THEN 'subject' END AS how FROM r LEFT JOIN c n ON n.repo_id = r.repo_id AND n.sha = r.named LEFT JOIN s ON s.repo_id = r.repo_id AND s.sha = r.sha""")
def j6_j7_resolve_reverts(spark, d):
    return links.resolve_reverts(fx.commits(spark, d))


@query(""", r AS (SELECT repo_id, sha, d, named, 'Order ' || (k - 7) AS want FROM c WHERE k % 7 = 0), s AS (SELECT r.repo_id, r.sha, r.d, coalesce(n.sha, o.sha) AS t FROM r LEFT JOIN c n ON n.repo_id = r.repo_id AND n.sha = r.named LEFT JOIN c o ON o.repo_id = r.repo_id AND o.subject = r.want AND o.d < r.d)
 SELECT repo_id, t AS sha, arg_max(sha, (d, sha)) AS superseded_by_sha FROM s WHERE t IS NOT NULL GROUP BY 1, 2""")
def k2_superseded(spark, d):
    c = fx.commits(spark, d)
    return links.superseded(links.dated_reverts(c), c)


@query(""", sp AS (SELECT l_orderkey AS g, l_linenumber AS n, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) AS b FROM lineitem), l AS (SELECT l_orderkey AS g, l_linenumber * 10 + l_partkey % 25 AS line_no FROM lineitem),
 h AS (SELECT DISTINCT l.g, l.line_no, n, a, b, row_number() OVER (PARTITION BY l.g, l.line_no ORDER BY b - a, a, n) AS r FROM (SELECT DISTINCT * FROM l) l JOIN sp ON sp.g = l.g AND l.line_no BETWEEN a AND b)
 SELECT g AS file, line_no, 's' || n AS symbol_id FROM h WHERE r = 1""")
def j8_lines_to_symbols(spark, d):
    li = fx.table(spark, d, "lineitem")
    start = F.col("l_linenumber") * 10
    spans = li.select(F.col("l_orderkey").alias("file"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("symbol_id"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))
    lines = li.select(F.col("l_orderkey").alias("file"), (start + F.col("l_partkey") % 25).alias("line_no")).distinct()
    return links.lines_to_symbols(lines, spans, ["file"])


@query(", x AS (SELECT DISTINCT repo_id, s, sn FROM cf) SELECT sn AS ref, min(s) AS symbol_id FROM x GROUP BY sn")
def j14_symbol_alias(spark, d):
    s = fx.symbols(spark, d)
    return links.symbol_alias(s.select(F.col("symbol_name").alias("ref")).distinct(), s)


@query(""", m AS (SELECT repo_id, 'commit:' || left(sha, 7) AS a, 'symbol:' || s AS b FROM cf), g AS (SELECT repo_id, 'pr:#' || number AS a, 'commit:' || left(merge_sha, 7) AS b FROM p)
 SELECT DISTINCT repo_id, a AS source_id, b AS target_id, 'modifies' AS edge_type, 'MODIFIES_SYMBOL' AS label FROM m UNION SELECT DISTINCT repo_id, a, b, 'merges', 'MERGES_COMMIT' FROM g""")
def g6_edges(spark, d):
    return links.materialise_edges(fx.commits(spark, d), fx.pulls(spark, d), fx.issues(spark, d)).drop("highlight")


# --- merges --------------------------------------------------------------------------------------------------------


@query("SELECT number, CASE WHEN number % 2 = 0 THEN 'new ' || number ELSE 'old ' || number END AS title, 'first' AS author FROM (SELECT k AS number FROM c) UNION ALL SELECT -k - 1, 'new ' || (-k - 1), 'second' FROM c WHERE k % 10 = 0")
def k3_upsert(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("number"))
    s = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    old = o.select("number", s("old ", F.col("number")).alias("title"), F.lit("first").alias("author"))
    new = o.where("number % 2 = 0").select("number", s("new ", F.col("number")).alias("title"), F.lit("second").alias("author"))
    more = o.where("number % 10 = 0").select((-F.col("number") - 1).alias("number"), s("new ", -F.col("number") - 1).alias("title"), F.lit("second").alias("author"))
    return merge.upsert(old, new.unionByName(more), ["number"], ("author",))


@query("SELECT id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN false ELSE embedded END AS embedded FROM ch")
def k5_upsert_chunks(spark, d):
    c = fx.chunks(spark, d)
    changed = c.withColumn("text", F.when(F.col("id").cast("bigint") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return merge.upsert_chunks(c, changed).select("id", "text", "embedded")


@query("SELECT id FROM ch WHERE source_type NOT IN ('file', 'code') OR doc_id % 2 = 0")
def k7_purge(spark, d):
    c = fx.chunks(spark, d)
    return merge.purge(c, c.where("id % 2 = 0"), ["file", "code"]).select("id")


@query("SELECT id, true AS embedded FROM ch")
def k6_mark_embedded(spark, d):
    c = fx.chunks(spark, d)
    return merge.mark_embedded(c, c.where("not embedded")).select("id", "embedded")


# --- graph ---------------------------------------------------------------------------------------------------------


@query("SELECT 'nation:' || c_nationkey AS node, 2 AS depth FROM customer WHERE c_custkey = 1 AND false UNION ALL SELECT b, 1 FROM e WHERE a = 'nation:3' UNION ALL SELECT y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a = 'nation:3' UNION ALL SELECT a, 1 FROM e WHERE b = 'nation:3'")
def g1_traverse(spark, d):
    seeds = spark.createDataFrame([("nation:3",)], "seed string")
    return graph.traverse(fx.place_edges(spark, d), seeds, 3).select("node", "depth")


@query("SELECT a AS node FROM e UNION SELECT b FROM e")
def g3_nodes(spark, d):
    return graph.nodes_of(fx.place_edges(spark, d))


def _pagerank_sql(rounds: int) -> str:
    sql = ", n AS (SELECT a AS v FROM es UNION SELECT b FROM es), o AS (SELECT a, count(*) AS t FROM es GROUP BY a), w AS (SELECT es.a, b, count(*) / any_value(t) AS s FROM es JOIN o ON o.a = es.a GROUP BY es.a, b), r0 AS (SELECT v, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"
    for i in range(rounds):
        sql += f", d{i} AS (SELECT coalesce(sum(r), 0) AS d FROM r{i} WHERE v NOT IN (SELECT a FROM o)), r{i + 1} AS MATERIALIZED (SELECT n.v, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(f, 0) + (SELECT d FROM d{i}) / (SELECT count(*) FROM n)) AS r FROM n LEFT JOIN (SELECT b, sum(s * r) AS f FROM w JOIN r{i} ON r{i}.v = w.a GROUP BY b) x ON x.b = n.v)"
    return sql + f" SELECT v AS node, CAST(floor(r * 100000 + 0.5) AS BIGINT) AS rank_e5 FROM r{rounds}"


@query(_pagerank_sql(20))
def g4a_pagerank(spark, d):
    r = graph.pagerank(fx.place_edges(spark, d, True), iterations=20, tolerance=0.0)
    return r.select("node", F.floor(F.col("rank") * 100000 + 0.5).alias("rank_e5"))


@query()
def g4b_betweenness(spark, d):
    return graph.betweenness(fx.place_edges(spark, d, True)).select("node", F.bround("betweenness", 6).alias("betweenness"))


# in the tree of all places each path between two nodes is the only one: a node lies on those from above it to below it
@query(""", up AS (SELECT b AS node, a AS above FROM e), anc AS (SELECT node, above FROM up UNION ALL SELECT x.node, y.above FROM up x JOIN up y ON y.node = x.above UNION ALL SELECT x.node, z.above FROM up x JOIN up y ON y.node = x.above JOIN up z ON z.node = y.above),
 n AS (SELECT a AS v FROM e UNION SELECT b FROM e), s AS (SELECT count(*)::DOUBLE AS n FROM n) SELECT v AS node, CAST(floor(coalesce(u, 0) * coalesce(d, 0) / ((n - 1) * (n - 2)) * 1e9 + 0.5) AS BIGINT) AS betweenness_e9
 FROM n CROSS JOIN s LEFT JOIN (SELECT node, count(*) AS u FROM anc GROUP BY 1) a ON a.node = v LEFT JOIN (SELECT above, count(*) AS d FROM anc GROUP BY 1) b ON b.above = v""")
def g4b_betweenness_of_all_places(spark, d):
    found = centrality.betweenness(fx.place_edges(spark, d))
    return found.select("node", F.floor(F.col("betweenness") * 1e9 + 0.5).alias("betweenness_e9"))


@query(_pagerank_sql(20).replace("any_value(t)", "any_value(o.t)").replace(" es ", " e ").replace("es.a", "e.a").replace("FROM es)", "FROM e)").replace("FROM es UNION", "FROM e UNION"))
def g4a_pagerank_of_all_places(spark, d):
    r = graph.pagerank(fx.place_edges(spark, d), iterations=20, tolerance=0.0)
    return r.select("node", F.floor(F.col("rank") * 100000 + 0.5).alias("rank_e5"))


@query(f"""SELECT {_uuid5("repo_id || ':commit:' || merge_sha || ':0'")} AS id, 0.04232::DOUBLE AS score, 'commit:' || left(merge_sha, 7) AS via FROM (SELECT * FROM p ORDER BY number, repo_id LIMIT 15)""")
def g5_follow_links(spark, d):
    c = written(fx.commits(spark, d), "history")
    edges = links.edge_rows(c, fx.pulls(spark, d), fx.issues(spark, d), whole_shas=True)  # a walk needs no distinct ones
    seeds = fx.pulls(spark, d).orderBy("number", "repo_id").limit(15)  # as many as are followed
    hits = seeds.select(F.concat(F.lit("h"), F.col("number").cast("string")).alias("id"), F.lit(0.05).alias("score"), F.array(T.node_key("pr", F.col("number"))).alias("refs"))
    return graph.follow_links(edges, hits, chunking.chunk_commits(c))


@query("""SELECT 'commit:' || left(sha, 7) AS source_id, 'symbol:' || s AS target_id, 'modifies' AS edge_type, 'MODIFIES_SYMBOL' AS label, false AS highlight FROM cf GROUP BY 1, 2
 UNION ALL SELECT 'pr:#' || number, 'commit:' || left(merge_sha, 7), 'merges', 'MERGES_COMMIT', false FROM p WHERE left(merge_sha, 7) IN (SELECT left(sha, 7) FROM c) GROUP BY 1, 2""")
def g7_knowledge_graph(spark, d):
    c = written(fx.commits(spark, d), "history")
    edges = links.materialise_edges(c, fx.pulls(spark, d), fx.issues(spark, d))
    return graph.knowledge_graph(c, fx.pulls(spark, d), fx.issues(spark, d), analytics.symbol_counts(c, fx.symbols_of(c)), edges)[1]


@query("""SELECT 'commit:' || left(sha, 7) AS source_id, 'symbol:' || s AS target_id, 'modifies' AS edge_type, 'MODIFIES_SYMBOL' AS label, false AS highlight FROM cf GROUP BY 1, 2
 UNION ALL SELECT 'pr:#' || number, 'commit:' || left(merge_sha, 7), 'merges', 'STORED', true FROM p GROUP BY 1, 2
 UNION ALL SELECT DISTINCT 'pr:#' || number, 'commit:' || left(ref, 7), 'merges', 'MERGED_IN_COMMIT', false FROM p WHERE left(ref, 7) IN (SELECT left(sha, 7) FROM c)
 UNION ALL SELECT 'commit:' || left(c.sha, 7), min_id, 'names', 'BARE', false FROM c JOIN (SELECT sn, 'symbol:' || min(s) AS min_id FROM cf GROUP BY sn) x ON x.sn = 'part' || (k % 50) GROUP BY 1, 2
 UNION ALL SELECT DISTINCT 'issue:#' || number, 'pr:#' || (number + 2), 'asks', 'BY NUMBER', false FROM i WHERE number + 2 IN (SELECT number FROM p)""")
def g7_aliases(spark, d):
    """Stored edges whose ends are full shas, bare symbol names and bare numbers, with the dynamic edges of the tables."""
    c, p, i = written(fx.commits(spark, d), "history"), fx.pulls(spark, d), fx.issues(spark, d)
    edge = lambda df, a, b, kind, label, mark=False: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(label).alias("label"), F.lit(mark).alias("highlight"))
    number = F.col("number").cast("string")
    stored = edge(p, F.concat(F.lit("#"), number), F.upper("merge_commit_sha"), "merges", "STORED", True)
    key = F.regexp_extract("message", r"Order (-?\d+)", 1).cast("bigint") + F.when(F.col("is_revert"), 7).otherwise(0)
    stored = stored.unionByName(edge(c, F.concat(F.lit("commit:"), "sha"), F.concat(F.lit("symbol:part"), (key % 50).cast("string")), "names", "BARE"))
    stored = stored.unionByName(edge(i, F.concat(F.lit("issue "), number), F.concat(F.lit("PR #"), (F.col("number") + 2).cast("string")), "asks", "BY NUMBER"))
    stored = stored.unionByName(edge(i, F.lit("symbol:no such"), F.lit("#999999999"), "asks", "NONE"))
    return graph.repaired_graph(c, p, i, fx.symbols_of(c).withColumn("commit_count", F.lit(1)), stored)[1]


# --- search --------------------------------------------------------------------------------------------------------

_MARKED = r"regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([0-9]+)', ' \1 ', 'g')"
_TOK = rf""", t0 AS (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM ch),
 t1 AS (SELECT id, w, CASE WHEN contains(w, '_') THEN list_concat([lower(w)], list_filter(string_split(lower(w), '_'), lambda x: x <> '')) ELSE [lower(w)] END AS own,
  list_filter(string_split_regex(lower(replace({_MARKED}, '_', ' ')), ' +'), lambda x: x <> '') AS camel FROM t0),
 t AS (SELECT id, unnest(CASE WHEN len(camel) > 1 THEN list_concat(own, list_filter(list_distinct(camel), lambda x: NOT list_contains(own, x))) ELSE own END) AS w FROM t1),
 tf AS (SELECT id, w, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, CAST(sum(tf) AS DOUBLE) AS len FROM tf GROUP BY id)"""
_BM25 = _TOK + """, n AS (SELECT count(*) AS n FROM ch), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), raw AS (SELECT w, ln((n - df + 0.5) / (df + 0.5)) AS i FROM df, n),
 idf AS (SELECT w, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM raw) ELSE i END AS i FROM raw), av AS (SELECT (SELECT sum(len) FROM l) / (SELECT n FROM n) AS a), q AS (SELECT * FROM (VALUES %s) v(w, m)),
 s0 AS (SELECT tf.id, sum(m * i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS s, count(*) AS o FROM tf JOIN q USING (w) JOIN idf USING (w) JOIN l ON l.id = tf.id, av GROUP BY tf.id),
 s AS (SELECT id, CASE WHEN s <= 0 THEN 0.5 * o ELSE s END AS s FROM s0)"""


@query(_TOK + " SELECT id, count(DISTINCT w) AS terms, count(*) AS words FROM t GROUP BY id")
def r1_token_stats(spark, d):
    tokens = fx.chunks(spark, d).select("id", T.code_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return tokens.select("id", F.size(F.array_distinct("t")).cast("bigint").alias("terms"), F.size("t").cast("bigint").alias("words"))


@query(_BM25 % "('the', 1), ('ther', 2), ('eaon', 1)" + " SELECT id, CAST(floor(s * 10000 + 0.5) AS BIGINT) AS score_e4 FROM s")
def r2_r3_bm25(spark, d):
    fitted = search.bm25_fit(fx.chunks(spark, d))
    asked = spark.createDataFrame([(0, "the ther ther eaon")], "query_id int, query string")
    return search.bm25_search(fitted, asked).select("id", F.floor(F.col("score") * 10000 + 0.5).alias("score_e4"))


@query("""SELECT v.vec_id AS id, CAST(floor(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 10000 + 0.5) AS BIGINT) AS score_e4 FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
 ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id LIMIT 10""")
def r9_cosine_top_k(spark, d):
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id = 0").first()
    return search.vector_search(v, list(q.embedding), 10).select("id", F.floor(F.col("score") * 10000 + 0.5).alias("score_e4"))


# by the remainder: related in three ways, said in three, longer numbers, a source; "pr 7" alone is not looked for; the sha is in the source
@query("SELECT id, 3.0::DOUBLE AS score FROM ch WHERE doc_id % 12 IN (0, 1, 2, 4, 5, 6) OR doc_id % 12 = 10 AND contains(md5(id), 'abc')")
def r11_exact_channel(spark, d):
    n, none = F.col("id").cast("bigint") % 12, F.array().cast("array<string>")
    related = F.when(n == 0, F.array(F.lit("pr#7"))).when(n == 1, F.array(F.lit("Issue#7"))).when(n == 2, F.array(F.lit("#7"))).when(n == 3, F.array(F.lit("pr#71"))).otherwise(none)
    said = F.when(n == 4, " see #7.").when(n == 5, " see PR #7").when(n == 6, " pr 7, that is #7x").when(n == 7, " in #70").when(n == 8, " pr 7").otherwise("")
    source = F.when(n == 10, F.md5("id")).when(n == 9, F.lit("7")).otherwise(F.lit("none"))
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "#7", "  "), "(?i)abc", "ab c")  # of itself a text names neither
    chunks = fx.chunks(spark, d).withColumns({"related_ids": related, "text": F.concat(plain, said), "source_id": source})
    return search.exact_channel(chunks, ["ABC"], [7], limit=None)


@query("SELECT id, 2.0::DOUBLE AS score FROM ch WHERE contains(sym, 'name7') ORDER BY id LIMIT 30")
def r12_symbol_channel(spark, d):
    known = spark.createDataFrame([("name7",)], "symbol_name string")
    return search.symbol_channel(fx.chunks(spark, d), "who wrote name7", known)


@query("SELECT id, 1.0::DOUBLE AS score FROM (SELECT id FROM ch WHERE contains(lower(text), 'ther') ORDER BY id LIMIT 10) UNION SELECT id, 1.0 FROM (SELECT id FROM ch WHERE contains(lower(text), 'eaon') ORDER BY id LIMIT 10)")
def r13_keyword_fallback(spark, d):
    return search.keyword_fallback(fx.chunks(spark, d), "ther eaon")


@query(""", h AS (SELECT 'dense' AS c, id, 1.0 / (1 + doc_id % 97) AS s FROM ch WHERE doc_id % 3 = 0 UNION ALL SELECT 'sparse', id, doc_id % 89 FROM ch WHERE doc_id % 2 = 0 UNION ALL SELECT 'exact', id, 3.0 FROM ch WHERE doc_id % 50 = 0),
 r AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY s DESC, id) AS rk FROM h), f AS (SELECT r.id, sum(CASE c WHEN 'exact' THEN 2.5 ELSE 1.0 END / (60 + rk)) AS s FROM r GROUP BY 1)
 SELECT f.id, CAST(floor(s * CASE WHEN source_type = 'commit' THEN greatest(0.35, exp(-0.03 * greatest(2024 - year(ts), 0))) WHEN source_type IN ('code', 'file') THEN 1.25 ELSE 1.0 END * CASE WHEN sym = 'mod::name7' THEN 1.75 ELSE 1.0 END * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM f JOIN ch ON ch.id = f.id""")
def r14_rrf(spark, d):
    c = fx.chunks(spark, d).withColumn("n", F.col("id").cast("bigint"))
    part = lambda name, cond, score: c.where(cond).select(F.lit(name).alias("channel"), "id", F.expr(score).cast("double").alias("score"))
    hits = part("dense", "n % 3 = 0", "1.0D / (1 + n % 97)").unionByName(part("sparse", "n % 2 = 0", "n % 89")).unionByName(part("exact", "n % 50 = 0", "3.0"))
    return search.rrf(hits, c, "where is name7", 2024, limit=None).select("id", F.floor(F.col("score") * 1e6 + 0.5).alias("score_e6"))


@query(_BM25 % "('ther', 1), ('eaon', 1), ('blend', 1)" + """, a AS (SELECT s.id, row_number() OVER (ORDER BY s DESC, s.id) AS rk FROM s JOIN ch ON ch.id = s.id WHERE source_type IN ('commit', 'pr')),
 f AS (SELECT a.id, 1.0 / (60 + rk) * CASE WHEN source_type = 'commit' THEN greatest(0.35, exp(-0.03 * greatest(2024 - year(ts), 0))) ELSE 1.0 END AS score, source_type, text FROM a JOIN ch ON ch.id = a.id WHERE rk <= 30)
 SELECT id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_e6, source_type, id AS source_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '[truncated]' ELSE text END AS text, true AS is_untrusted_data
 FROM f ORDER BY score DESC, id LIMIT 10""")
def r15_search_history(spark, d):
    found = search.search_history(fx.chunks(spark, d), None, "ther eaon blend", 2024, source_types=["commit", "pr"])
    return found.select("id", F.floor(F.col("score") * 1e6 + 0.5).alias("score_e6"), "source_type", "source_id", "text", "is_untrusted_data")


@query(", r AS (SELECT id, doc_id % 4 AS q, doc_id % 101 AS s, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id % 101 DESC, id) AS rn FROM ch WHERE source_type = 'pr') SELECT id, row_number() OVER (ORDER BY CASE WHEN rn <= 3 THEN 0 ELSE 1 END, CASE WHEN rn <= 3 THEN rn ELSE 0 END, CASE WHEN rn <= 3 THEN q ELSE 0 END, s DESC, id) AS pos FROM r")
def w2_interleave(spark, d):
    n = F.col("id").cast("bigint")
    hits = fx.chunks(spark, d).where("source_type = 'pr'").select((n % 4).alias("sub_question_idx"), "id", (n % 101).alias("score"))
    return search.interleave(hits).select("id", F.col("pos").cast("bigint").alias("pos"))


@query(", r AS (SELECT doc_id AS pos, text, sum(length(text)) OVER (ORDER BY doc_id) AS e FROM documents), o AS (SELECT min(pos) AS p FROM r WHERE e > 16000) SELECT pos, CASE WHEN pos = p THEN substr(text, 1, CAST(16000 - (e - length(text)) AS INT)) ELSE text END AS line FROM r, o WHERE pos < p OR p IS NULL OR (pos = p AND 16000 - (e - length(text)) > 200) OR (pos = p AND e = length(text))")
def w3_budget(spark, d):
    return search.within_budget(fx.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("line")), 16000)


@query("SELECT l_orderkey AS file, l_linenumber AS n, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, l_linenumber + 50) AS end_line FROM lineitem")
def w6_missing_ends(spark, d):
    li = fx.table(spark, d, "lineitem")
    starts = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("string").alias("symbol_id"), F.col("l_linenumber").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return links.with_ends(starts, ["file"]).select("file", F.col("start_line").alias("n"), "end_line")


_CFL = """, cfl AS (SELECT sha, l_linenumber AS ln, l_suppkey AS a, l_partkey AS b, 'supp/' || l_suppkey || '::part' || (l_partkey % 50) AS s FROM c JOIN lineitem ON l_orderkey = k),
 sy AS (SELECT sha, string_agg(s, ', ' ORDER BY o) AS syms, any_value(m) AS n_syms FROM (SELECT sha, s, o, count(*) OVER (PARTITION BY sha) AS m, row_number() OVER (PARTITION BY sha ORDER BY o) AS r FROM (SELECT sha, s, min(o) AS o FROM (SELECT sha, s, row_number() OVER (PARTITION BY sha ORDER BY ln, a, b) AS o FROM cfl) GROUP BY sha, s)) WHERE r <= 10 GROUP BY sha)"""


# --- chunking and functions ----------------------------------------------------------------------------------------


@query(f"""{_CFL}, m AS (SELECT c.*, CASE WHEN k % 7 = 0 THEN subject || CASE WHEN named IS NOT NULL THEN chr(10) || chr(10) || 'This reverts commit ' || named || '.' ELSE '' END ELSE subject || chr(10) || chr(10) || 'Fixes #' || (k % 50) END AS message FROM c),
 x AS (SELECT repo_id, m.sha, 'Commit ' || left(m.sha, 7) || ' by ' || author || coalesce(chr(10) || 'Symbols: ' || syms, '') || chr(10) || message AS text FROM m LEFT JOIN sy ON sy.sha = m.sha)
 SELECT {_uuid5("repo_id || ':commit:' || sha || ':0'")} AS id, sha AS source_id, text, CAST(ceil(length(text) / 4) AS INT) AS token_count FROM x""")
def c3_commit_chunks(spark, d):
    return chunking.chunk_commits(fx.commits(spark, d)).select("id", "source_id", "text", "token_count")


@query(f"""SELECT {_uuid5("repo_id || ':pr:' || number || ':0'")} AS id, 'pr' AS source_type, CAST(number AS VARCHAR) AS source_id, 'PR #' || number || ': PR ' || number || chr(10) || 'Fixes #' || (number + 1) || ' and see #' || (number + 4) || '.' AS text FROM p
 UNION ALL SELECT {_uuid5("repo_id || ':issue:' || number || ':0'")}, 'issue', CAST(number AS VARCHAR), 'Issue #' || number || ': Issue ' || number || chr(10) || 'Broken by #' || (number + 2) || '.' FROM i""")
def c4_c5_pull_issue_chunks(spark, d):
    none = F.array().cast("array<struct<author:string,user:string,path:string,line:int,body:string,created_at:string>>")
    p, i = (t.withColumn("comments", none).withColumn("review_comments", none) for t in (fx.pulls(spark, d), fx.issues(spark, d)))
    return chunking.chunk_pulls(p).unionByName(chunking.chunk_issues(i)).select("id", "source_type", "source_id", "text")


@query(f"""SELECT {_uuid5("'r:file:' || source_id || ':' || n")} AS id, source_id, part AS text, CAST(ceil(length(part) / 4) AS INT) AS token_count FROM (SELECT lang || '/' || doc_id AS source_id, n, substr(text, CAST(n * 3000 + 1 AS BIGINT), 3000) AS part
 FROM documents, unnest(range(CAST(greatest(ceil(length(text) / 3000), 1) AS BIGINT))) u(n))""")
def c7_file_chunks(spark, d):
    files = fx.table(spark, d, "documents").select(F.lit("r").alias("repo_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("file_path"), "text")
    return chunking.chunk_files(files).select("id", "source_id", "text", "token_count")


@query(f"""{_CFL}, fp AS (SELECT c.repo_id, c.sha, c.k, 'Files modified (' || count(f) || '): ' || coalesce(array_to_string((list(f ORDER BY ln, a, b) FILTER (f IS NOT NULL))[1:5], ', '), '') || CASE WHEN count(f) > 5 THEN ' (+' || (count(f) - 5) || ' more)' ELSE '' END
  || ' (+' || count(f) || '/-0 lines)' AS files FROM (SELECT c.repo_id, c.sha, c.k, 'supp/' || l_suppkey AS f, l_linenumber AS ln, l_suppkey AS a, l_partkey AS b FROM c LEFT JOIN lineitem ON l_orderkey = k) c GROUP BY 1, 2, 3),
 pc AS (SELECT c.repo_id, c.sha, max(p.number) AS n FROM c JOIN p ON p.repo_id = c.repo_id AND (starts_with(c.sha, p.ref) OR c.sha = p.merge_sha) GROUP BY 1, 2)
 SELECT fp.sha, files || coalesce(chr(10) || 'Symbols: ' || syms || CASE WHEN n_syms > 10 THEN ' (+' || (n_syms - 10) || ' more)' ELSE '' END, '') || coalesce(chr(10) || 'PR #' || n || ': PR ' || n || ' Fixes #' || (n + 1) || ' and see #' || (n + 4) || '.', '') AS diff_summary FROM fp LEFT JOIN sy ON sy.sha = fp.sha LEFT JOIN pc ON pc.sha = fp.sha AND pc.repo_id = fp.repo_id""")
def c8_footprint(spark, d):
    c = fx.commits(spark, d)
    return chunking.footprint(c, links.pull_of_commit(fx.pulls(spark, d), c), fx.pulls(spark, d)).select("sha", "diff_summary")


@query("SELECT id, CAST(ceil(length(text) / 4) AS INT) AS tokens FROM ch")
def c1_token_count(spark, d):
    return fx.chunks(spark, d).select("id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT repo_id, number, CAST(number + 1 AS VARCHAR) AS closes, CAST(number + 4 AS VARCHAR) AS mentions FROM p")
def f1_extract_refs(spark, d):
    r = T.extract_refs(F.col("body"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return fx.pulls(spark, d).select("repo_id", F.col("number").cast("bigint").alias("number"), join(r["closes"]).alias("closes"), join(r["mentions"]).alias("mentions"))


@query("SELECT sha, 'Order ' || (k - 7) AS subject, named AS target FROM c WHERE k % 7 = 0")
def f2_f3_revert_message(spark, d):
    return fx.commits(spark, d).where("is_revert").select("sha", T.reverted_subject(F.col("message")).alias("subject"), T.revert_target(F.col("message")).alias("target"))


@query("""SELECT l_orderkey AS key, 'supp/' || l_suppkey || '.py' AS name, 'added' AS kind, l_linenumber * 10 + 1 AS line FROM lineitem UNION ALL SELECT l_orderkey, 'old/' || l_partkey || '.py', 'deleted', 1 FROM lineitem
 UNION ALL SELECT o_orderkey, 'src/' || o_orderkey || '.py::C' || o_custkey, 'class', 1 FROM orders UNION ALL SELECT o_orderkey, 'src/' || o_orderkey || '.py::C' || o_custkey || '::m' || o_orderkey, 'method', 2 FROM orders UNION ALL SELECT o_orderkey, 'src/' || o_orderkey || '.py::f', 'function', 5 FROM orders""")
def f4_f5_diff_and_symbols(spark, d):
    change = "'--- a/supp/', l_suppkey, '.py\\n+++ b/supp/', l_suppkey, '.py\\n@@ -', l_linenumber * 10, ',1 +', l_linenumber * 10, ',2 @@\\n context\\n+added\\n--- a/old/', l_partkey, '.py\\n+++ /dev/null\\n@@ -1 +0,0 @@\\n-gone\\n'"
    diffs = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.expr(f"array_join(collect_list(concat({change})), '')").alias("diff"))
    source = "concat('class C', o_custkey, ':\\n    def m', o_orderkey, '(self):\\n        return 1\\n\\ndef f():\\n    return 2\\n')"
    files = fx.table(spark, d, "orders").selectExpr("o_orderkey AS key", f"{source} AS code", "concat('src/', o_orderkey, '.py') AS path")
    lines = code.with_lines(diffs, ["key"]).select("key", F.col("path").alias("name"), F.col("side").alias("kind"), F.col("line_no").alias("line"))
    found = code.with_symbols(files.select("key", F.col("path").alias("file_path"), F.col("code").alias("text")), ["key"])
    return lines.unionByName(found.select("key", F.col("symbol_id").alias("name"), "kind", F.col("start_line").alias("line")))


@query()
def f13_f15_metrics(spark, d):
    """Whole texts, the first half of each against the second (citations of all of it): a row holds both sides, so no text is shuffled."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = fx.table(spark, d, "documents").select("doc_id", "text", F.coalesce(F.left("text", half), F.lit("")).alias("a"), F.coalesce(F.substr("text", half + 1), F.lit("")).alias("b"))
    m = evaluate.citation_metrics(F.col("text"), F.array(F.lit("#1")))
    return rows.select("doc_id", F.bround(code.rouge_l("a", "b"), 6).alias("rouge_l"), m["f1"].alias("citation_f1"), F.bround(evaluate.keyword_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, 12 AS insertions, 5 AS deletions, 'src/new/a.py,b.py,img.png' AS files, o_orderkey % 5 = 0 AS is_revert FROM orders")
def s1_s3_parse_log(spark, d):
    title = "CASE WHEN o_orderkey % 5 = 0 THEN 'Revert: things' WHEN o_orderkey % 5 = 1 THEN 'Revert to the old way' ELSE concat('Order ', o_orderkey) END"
    fields = ["md5(cast(o_orderkey as string))", "'Ann'", "'ann@x.org'", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ssXXX\")", "''", title]
    head = F.concat_ws("\x1f", *(F.expr(f) for f in fields))
    stat = F.lit("\x1fNUMSTAT\n10\t5\tsrc/{old => new}/a.py\n2\t0\tb.py\n-\t-\timg.png\n")
    return history.parse_commits(fx.table(spark, d, "orders").select(F.concat(head, stat).alias("record")), "repo").select("sha", "insertions", "deletions", F.array_join("files_changed", ",").alias("files"), "is_revert")


@query(""", r AS (SELECT repo_id, sha, d, named, 'Order ' || (k - 7) AS want, k FROM c WHERE k % 7 = 0), s AS (SELECT r.repo_id, r.sha, r.k, coalesce(n.sha, o.sha) AS t FROM r LEFT JOIN c n ON n.repo_id = r.repo_id AND n.sha = r.named LEFT JOIN c o ON o.repo_id = r.repo_id AND o.subject = r.want AND o.d < r.d),
 x AS (SELECT sha, k % 5 AS v, CAST(regexp_matches(left(sha, 7), '[a-f]') AS INT) + CAST(regexp_matches(left(t, 7), '[a-f]') AS INT) AS cites FROM s WHERE t IS NOT NULL)
 SELECT sha AS draft_id, v IN (0, 3) AS passed, v IN (0, 3) AND cites > 0 AS fast_pass, CASE WHEN v = 4 THEN round_even((cites + 0) / (cites + 1.0), 4) ELSE 1.0 END AS score FROM x""")
def v_claims(spark, d):
    c = written(fx.commits(spark, d), "history")
    done = links.resolve_reverts(c).select("repo_id", "sha", F.col("reverts_sha").alias("_r"))
    c = c.join(done, ["repo_id", "sha"], "left").withColumn("reverts_sha", F.col("_r")).drop("_r")
    c = written(c, "reverting")
    evidence = written(verify.evidence_index(c, chunking.chunk_commits(c)), "evidence")
    a, b = F.left("sha", F.lit(7)), F.left("reverts_sha", F.lit(7))
    v = F.regexp_extract("message", r"Order (\d+)", 1).cast("bigint") % 5  # the reverted order; seven more is this one
    v = (v + 7) % 5
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    claim = F.when(v == 0, say("Commit ", a, " reverts commit ", b, ".")).when(v == 1, say("Commit ", b, " undid commit ", a, ".")).when(v == 2, say("Commit ", a, " reverted commit ", b, ", as abcdef1 says."))
    claim = claim.when(v == 3, say("Commit ", b, " was reverted by commit ", a, ".")).otherwise(say("Commit ", a, " reverts commit ", b, " in `invented_name`."))
    drafts = written(c.where("reverts_sha is not null").select(F.col("sha").alias("draft_id"), claim.alias("draft")), "drafts")
    pulls, issues = fx.pulls(spark, d), fx.issues(spark, d)
    cited = written(verify.citations(drafts, evidence, pulls, issues, c), "cited")
    errors = verify.claim_errors(drafts, evidence, pulls, issues, c, cited)
    text = drafts.select("draft_id", F.lit("what the evidence says").alias("evidence"))
    return verify.verdicts(drafts, errors, verify.grounding(drafts, text), cited)


from annalist.plans import facts, lookups  # noqa: E402, F401
