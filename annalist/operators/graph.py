"""Graph operators over typed edges: traversal, topology, link following, export."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import node_key
from annalist.operators import centrality, links
from annalist.storage import shared_folder, written

DECAY = 0.92  # score kept per hop
FLOOR = 0.012


def seed_variants(seed: str) -> list[str]:
    """Node ids that a free-form reference may mean."""
    seed = seed.strip()
    out = [seed]
    if m := re.fullmatch(r"(#?)(\d+)", seed):
        out += [f"issue:#{m[2]}", f"pr:#{m[2]}", m[2] if m[1] else f"#{m[2]}"]
    elif m := re.fullmatch(r"(pr|issue)\s*:?#?(\d+)", seed, re.I):
        out += [f"{m[1].lower()}:#{m[2]}", f"#{m[2]}", m[2]]
    elif m := re.fullmatch(r"(?:commit[:#])?([0-9a-f]{7,40})", seed, re.I):
        out.append(f"commit:{m[1][:7].lower()}")
    return list(dict.fromkeys(out))


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, direction: str = "both", compat: bool = False) -> DataFrame:
    """(seed, node, depth, edge_type, label, path, direction) reached from ``seeds`` (seed); the shortest way to a node wins.

    Each hop is written, and goes on only from nodes that the seed meets first in it, so neither dense graphs nor cycles
    multiply paths. A hop reads ``edges`` once, for both ways, and joins them as they come: beside a front that Spark broadcasts
    they are neither shuffled nor written. Parallel edges may be among them. With ``compat`` an incoming walk
    also returns what is reached outgoing.
    """
    ways = {"outgoing": ["outgoing"], "incoming": ["outgoing", "incoming"] if compat else ["incoming"], "both": ["outgoing", "incoming"]}[direction]
    parts = []
    ends = {"outgoing": ("source_id", "target_id"), "incoming": ("target_id", "source_id")}
    taken = [F.struct(F.col(ends[way][0]).alias("node"), F.col(ends[way][1]).alias("next"), F.lit(way).alias("direction")) for way in ways]
    step = edges.where("source_id is not null and target_id is not null").select("edge_type", "label", F.inline(F.array(*taken)))
    front = written(seeds.select("seed").distinct(), "seeds").select("seed", F.col("seed").alias("node"), F.col("seed").alias("path"), F.explode(F.array(*map(F.lit, ways))).alias("direction"))
    met = None
    for depth in range(1, max_depth + 1):
        arrow = F.concat("path", F.when(F.col("direction") == "outgoing", " -> ").otherwise(" <- "), "next")
        reached = front.join(step, ["node", "direction"]).select("seed", F.col("next").alias("node"), F.lit(depth).alias("depth"), "edge_type", "label", arrow.alias("path"), "direction")
        if met is not None:
            reached = reached.join(met, ["seed", "node", "direction"], "left_anti")
        best = reached.groupBy("seed", "node", "direction", "depth").agg(F.min(F.struct("path", "edge_type", "label")).alias("w"))
        level = written(best.select("seed", "node", "depth", "w.edge_type", "w.label", "w.path", "direction"), "reached")
        parts.append(level)
        met = level.select("seed", "node", "direction") if met is None else met.unionByName(level.select("seed", "node", "direction"))
        front = level.select("seed", "node", "path", "direction")
        if depth < max_depth and front.isEmpty():
            break
    result = reduce(DataFrame.unionByName, parts)
    first = F.min(F.struct("depth", F.when(F.col("direction") == "outgoing", 0).otherwise(1).alias("o"), "path", "edge_type", "label", "direction")).alias("w")
    return result.groupBy("seed", "node").agg(first).select("seed", "node", "w.depth", "w.edge_type", "w.label", "w.path", "w.direction")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank), ranks summing to one. Parallel edges add weight; nodes without edges out spread their rank evenly.

    Nodes without edges out whose one edge in brings the same share of the same node always have equal ranks: they are one row
    with their number ``m`` while ranks are iterated, and get their ranks from it at the end.
    Edges are weighted once; an iteration is one join on the source and one aggregation by target, and its result is
    checkpointed, since the next one reads it. Stops when the summed change is under ``tolerance`` per node.
    """
    weight = edges.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    weight = written(weight, "weights")
    out = weight.groupBy("src").agg(F.sum("w").alias("t"))
    links = weight.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share"))
    into = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"), F.min(F.struct("src", "share")).alias("one"))
    nodes = nodes_of(edges).join(out.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left").join(into.withColumnRenamed("dst", "node"), "node", "left")
    alike = F.col("has_out").isNull() & (F.col("n_in") == 1)
    unit = F.when(alike, F.struct(F.col("one.src").alias("of"), F.col("one.share").alias("share"))).otherwise(F.struct(F.col("node").alias("of"), F.lit(None).cast("double").alias("share")))
    nodes = written(nodes.select("node", F.coalesce("has_out", F.lit(False)).alias("has_out"), unit.alias("unit")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = written(nodes.groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.first("has_out").alias("has_out")), "units").withColumn("rank", F.lit(1.0 / n))
    own = nodes.where("unit.share is null").select(F.col("node").alias("dst"), "unit")
    links = links.join(own, "dst").select("src", "share", "unit").unionByName(ranks.where("unit.share is not null").select("unit.of", "unit.share", "unit").toDF("src", "share", "unit"))
    links = written(links, "links")
    for _ in range(iterations):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(~F.col("has_out"), F.col("rank") * F.col("m"))), F.lit(0.0)).alias("d"))  # one row
        sending = ranks.where("has_out").select(F.col("unit.of").alias("src"), "rank")
        flow = links.join(sending, "src").groupBy("unit").agg(F.sum(F.col("rank") * F.col("share")).alias("in_rank"))
        new = ranks.join(flow, "unit", "left").crossJoin(F.broadcast(dangling))
        new = new.select("unit", "m", "has_out", ((1 - alpha) / n + alpha * (F.coalesce("in_rank", F.lit(0.0)) + F.col("d") / n)).alias("rank"), F.col("rank").alias("before"))
        new = _saved(new)
        ranks = new.drop("before")
        if tolerance > 0 and new.agg(F.sum(F.col("m") * F.abs(F.col("rank") - F.col("before")))).first()[0] < n * tolerance:
            break
    return nodes.select("node", "unit").join(ranks.select("unit", "rank"), "unit").select("node", "rank")


def _saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def tenant_edges(edges: DataFrame, repo_id: str | None) -> DataFrame:
    """Edges of a tenant: equal ignoring case, or equal after a slash; edges without one count only if no edge has any."""
    if not repo_id:
        return edges
    low, want = F.lower(F.coalesce("repo_id", F.lit(""))), repo_id.lower()
    none = edges.where(low != "").isEmpty()
    return edges.where((low == want) | F.endswith(low, F.lit(f"/{want}")) | (F.lit(none) & (low == "")))


def betweenness(edges: DataFrame, max_edges: int = 5_000_000) -> DataFrame:
    """(node, betweenness): Brandes over unweighted directed edges, normalised, end points excluded.

    Sources are dealt to tasks, each with the whole adjacency as a broadcast of two packed arrays: 4 bytes an edge and
    8 a node, so some 60 MB at the most. Partial dependencies are summed by node. Graphs over ``max_edges`` distinct
    edges go to ``centrality.betweenness``, which holds the graph nowhere. An edge without one of its ends does not count.
    """
    import numpy as np
    import pyarrow as pa

    spark = edges.sparkSession
    pairs = edges.select("source_id", "target_id").dropna().distinct()
    if pairs.count() > max_edges:
        return centrality.betweenness(pairs).drop("error")
    table = pairs.toArrow()
    ends = pa.chunked_array(table["source_id"].chunks + table["target_id"].chunks, pa.string()).dictionary_encode().unify_dictionaries()
    names = ends.chunk(0).dictionary if ends.num_chunks else pa.array([], pa.string())
    codes = np.concatenate([c.indices.to_numpy() for c in ends.chunks] or [np.empty(0, np.int32)])
    source, target = np.split(codes, 2)
    starts = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(names)))])
    shared = spark.sparkContext.broadcast((starts, target[np.argsort(source, kind="stable")].astype(np.int32)))

    def run(batches):
        from collections import deque

        (starts, target), total = shared.value, {}
        for batch in batches:
            for s in batch.column(0).to_pylist():
                order, before, paths, far = [], {}, {s: 1.0}, {s: 0}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in target[starts[v] : starts[v + 1]].tolist():
                        if w not in far:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                depends = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        depends[v] += paths[v] / paths[w] * (1 + depends[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + depends[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["v", "b"])

    n = len(names)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = spark.range(n).mapInArrow(run, "v long, b double").groupBy("v").agg(F.sum("b").alias("b"))
    ids = spark.createDataFrame(pa.table({"v": pa.array(range(n), pa.int64()), "node": names}))
    return ids.join(sums, "v", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def topology(edges: DataFrame, top_n: int = 20) -> dict:
    """Counts and the top nodes by PageRank and betweenness, rounded to six places; zeros and empty lists without edges."""
    n_edges = edges.count()
    if not n_edges:
        return {"total_nodes": 0, "total_edges": 0, "top_pagerank": [], "top_betweenness": []}
    top = lambda df, c: [(r.node, r.score) for r in df.select("node", F.bround(c, 6).alias("score")).orderBy(F.desc("score"), "node").limit(top_n).collect()]
    return {"total_nodes": nodes_of(edges).count(), "total_edges": n_edges, "top_pagerank": top(pagerank(edges), "rank"), "top_betweenness": top(betweenness(edges), "betweenness")}


def follow_links(edges: DataFrame, hits: DataFrame, chunks: DataFrame, depth: int = 2, max_seeds: int = 15, per_ref: int = 5) -> DataFrame:
    """Chunks reached over the graph from ``hits`` (id, score, refs), with inherited scores.

    A hop keeps DECAY of its seed's score, the best path counts, and fetching the chunk costs one DECAY more. Commits of the edges
    go by seven characters of their shas or by all; ``via`` names seven.
    """
    hits = written(hits.select("id", "score", "refs"), "hits")
    seeds = hits.select("score", F.explode("refs").alias("seed")).groupBy("seed").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "seed").limit(max_seeds)
    reached = traverse(edges, seeds, depth).join(seeds, "seed").groupBy("node").agg(F.max(F.col("score") * F.pow(F.lit(DECAY), F.col("depth"))).alias("parent")).join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
    reached = written(reached, "reached")  # its size is known then, and chunks aren't shuffled beside a small one
    is_commit = F.col("source_type").isin("commit", "commit_diff", "historical_commit")
    whole = F.array_compact(F.array(F.when(is_commit, F.concat(F.lit("commit:"), F.regexp_replace("source_id", "^#", "")))))
    keyed = chunks.select("id", F.explode(F.array_union(chunk_keys(), whole)).alias("node"))
    ranked = reached.join(keyed, "node").withColumn("_r", F.row_number().over(_by("node", "id"))).where(F.col("_r") <= per_ref)
    fresh = ranked.join(hits.select("id"), "id", "left_anti")
    return fresh.groupBy("id").agg(F.bround(F.greatest(F.lit(FLOOR), F.max("parent") * DECAY), 6).alias("score"), F.min(F.regexp_replace("node", "^(commit:[0-9a-fA-F]{7})[0-9a-fA-F]+$", "$1")).alias("via"))


def _by(key: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(order)


def chunk_keys():
    """Graph nodes that a chunk stands for."""
    kind, source = F.col("source_type"), F.regexp_replace("source_id", "^#", "")
    return F.array_compact(
        F.array(
            F.when(kind.isin("pr", "pull_request"), node_key("pr", source)), F.when(kind == "issue", node_key("issue", source)),
            F.when(kind.isin("commit", "commit_diff", "historical_commit"), node_key("commit", source)), F.when(kind.isin("code", "source_code", "ast_symbol"), node_key("symbol", source)),
        )
    )


def related_nodes():
    """Graph nodes that a chunk's ``related_ids`` ("pr#7", "issue#5", "commit#<sha>") name."""
    kind = lambda r: F.lower(F.substring_index(r, "#", 1))
    value = lambda r: F.substring_index(r, "#", -1)
    node = lambda r: F.when(kind(r) == "commit", node_key("commit", value(r))).when(kind(r).isin("pr", "issue"), F.concat(kind(r), F.lit(":#"), value(r)))
    return F.array_compact(F.transform(F.coalesce("related_ids", F.array().cast("array<string>")), node))


def knowledge_graph(commits: DataFrame, pulls: DataFrame, issues: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 250, include_all: bool = True, n_symbols: int = 60) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for export: all reverts, the latest ``limit`` commits and those with links; both ends of an edge exist."""
    edges = written(edges, "edges")  # read for the nodes and for the result
    nodes = written(_graph_nodes(commits, pulls, issues, symbols, nodes_of(edges), limit, include_all, n_symbols), "nodes")
    ids = nodes.select("id")
    ends = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, ends.groupBy("source_id", "target_id", "edge_type").agg(F.min("label").alias("label"), F.max("highlight").alias("highlight"))


def _graph_nodes(commits: DataFrame, pulls: DataFrame, issues: DataFrame, symbols: DataFrame, ends: DataFrame, limit: int, include_all: bool, n_symbols: int) -> DataFrame:
    """(id, type, label) of the graph whose edges have ``ends`` (node). Commits are read once, with what a node needs of them."""
    special = F.coalesce("is_revert", F.lit(False)) | F.col("reverts_sha").isNotNull() | F.col("superseded_by_sha").isNotNull()
    commits = written(commits.select("sha", F.substring_index("message", "\n", 1).alias("subject"), "authored_date", special.alias("special")), "commits")
    latest = commits.orderBy(F.desc("authored_date"), "sha").limit(limit)
    named = ends.where(F.startswith("node", F.lit("commit:"))).select(F.substring("node", 8, 7).alias("sha7"))
    linked = commits.where("not special").withColumn("sha7", F.left("sha", F.lit(7))).join(named, "sha7", "left_semi").drop("sha7")
    kept = commits.where("special").unionByName(latest).unionByName(linked)
    chosen = symbols if include_all else symbols.orderBy(F.desc("commit_count"), "symbol_id").limit(n_symbols)
    node = lambda df, kind, value, label: df.select(node_key(kind, value).alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    nodes = node(kept, "commit", F.col("sha"), F.col("subject")).unionByName(node(pulls, "pr", F.col("number"), F.col("title")))
    nodes = nodes.unionByName(node(issues, "issue", F.col("number"), F.col("title"))).unionByName(node(chosen, "symbol", F.col("symbol_id"), F.col("symbol_name")))
    return nodes.groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"))


def canonical_nodes(ends: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node, canonical): for each of ``ends`` (node) the one of ``nodes`` (id) that it means; ends that mean none are left out.

    A node means itself; a sha of seven characters or more, with or without "commit:", its commit; "#N", "pr#N", "issue 7" and the
    like the pull or issue of that number, of a bare number the pull first; a symbol's id, bare name or last segment, with
    or without "symbol:", the symbol (``links.symbol_alias``).
    """
    node = F.col("node")
    marked = ends.select("node").dropna().distinct().join(nodes.select(F.col("id").alias("node")).distinct().withColumn("_is", F.lit(True)), "node", "left")
    marked = written(marked, "ends")
    itself = marked.where("_is").select("node", node.alias("canonical"))
    ends = marked.where("_is is null").select("node")
    sha = F.lower(F.regexp_extract(node, r"^(?:commit[:#\s]*)?([0-9a-fA-F]{7,40})$", 1))
    kind = F.lower(F.regexp_extract(node, r"(?i)^(pr|issue)?[:\s]*#?\d+$", 1))
    number = F.regexp_extract(node, r"(?i)^(?:pr|issue)?[:\s]*#?(\d+)$", 1)
    option = lambda cond, value, order: F.when(cond, F.struct(value.alias("to"), F.lit(order).alias("order")))
    options = F.array_compact(
        F.array(
            option(sha != "", node_key("commit", sha), 1),
            option((number != "") & (kind != "issue"), node_key("pr", number), 2), option((number != "") & (kind != "pr"), node_key("issue", number), 3),
        )
    )
    meant = ends.select("node", F.explode(options).alias("o")).select("node", "o.to", "o.order")
    named = links.symbol_alias(ends.select("node", F.regexp_replace("node", "^symbol:", "").alias("ref")), symbols).where("symbol_id is not null")
    meant = meant.unionByName(named.select("node", node_key("symbol", F.col("symbol_id")).alias("to"), F.lit(4).alias("order")))
    there = meant.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    return itself.unionByName(there.groupBy("node").agg(F.min_by("to", "order").alias("canonical")))


def dynamic_edges(commits: DataFrame, pulls: DataFrame, issues: DataFrame) -> DataFrame:
    """The edges that the tables give now: those that are stored, and the commits that pulls name."""
    named = pulls.select("repo_id", "number", F.explode("linked_commit_shas").alias("sha")).where(F.length("sha") >= 7)
    merged = named.select(
        F.coalesce("repo_id", F.lit("")).alias("repo_id"), node_key("pr", F.col("number")).alias("source_id"), node_key("commit", F.col("sha")).alias("target_id"),
        F.lit("merges").alias("edge_type"), F.lit("MERGED_IN_COMMIT").alias("label"), F.lit(False).alias("highlight"),
    )
    return links.materialise_edges(commits, pulls, issues).unionByName(merged)


def repaired_graph(commits: DataFrame, pulls: DataFrame, issues: DataFrame, symbols: DataFrame, stored: DataFrame, limit: int = 250, include_all: bool = True) -> tuple[DataFrame, DataFrame]:
    """``knowledge_graph`` of the stored and the dynamic edges, with the ends of both brought to their canonical nodes first.

    Of edges that are then equal in source, target and type, a stored one gives label and mark.
    """
    kept = ("source_id", "target_id", "edge_type", "label", "highlight")
    edges = stored.select(*kept, F.lit(0).alias("_p")).unionByName(dynamic_edges(commits, pulls, issues).select(*kept, F.lit(1).alias("_p")))
    edges = written(edges, "edges")
    ends = written(nodes_of(edges), "ends")
    nodes = written(_graph_nodes(commits, pulls, issues, symbols, ends, limit, include_all, 60), "nodes")
    canonical = written(canonical_nodes(ends, nodes, symbols), "canonical")
    source, target = (canonical.select(F.col("node").alias(c), F.col("canonical").alias(f"_{c}")) for c in ("source_id", "target_id"))
    meant = edges.join(source, "source_id").join(target, "target_id").groupBy("_source_id", "_target_id", "edge_type")
    first = meant.agg(F.min(F.struct("_p", "label", "highlight")).alias("e"))
    return nodes, first.select(F.col("_source_id").alias("source_id"), F.col("_target_id").alias("target_id"), "edge_type", "e.label", "e.highlight")
