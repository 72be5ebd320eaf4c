"""Betweenness centrality of graphs that no task holds: level by level searches and back-propagation, as joins.

For a batch of sources, the level tables hold (source, node, paths): the nodes at that distance and the number of shortest
paths to them. A level is the join of the last one with the edges, without the nodes that the source has met; shares of
dependency flow back from the last level to the first, over the same edges. All tables are written in the shared folder
and deleted with their batch; the graph and the levels are never broadcast or collected.

Before that the ends of trees are taken off, round by round: a node without an edge out and with one edge in lies on the only
path from its parent to what was taken off below it, so its value is the number of sources that reach it times the number
of nodes below. The searches run over what is left, where a node counts for all that was taken off below it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.storage import Files, shared_folder, written

BATCH = 16_384  # sources that are searched from together
LEAST_TAKEN = 8  # a round that takes off less than one edge in so many is the last: rounds cost no more than a few reads of all edges


def betweenness(edges: DataFrame, pivots: int | None = None, confidence: float = 0.95, batch: int = BATCH) -> DataFrame:
    """(node, betweenness, error) over unweighted directed edges, normalised, end points excluded.

    Exact without ``pivots`` (error 0). With it, the search starts from that many sources, chosen by their hashes among all
    nodes, and the sums are scaled up; with probability ``confidence`` no node's value is off by more than ``error``
    (Hoeffding's bound over all nodes). An edge without one of its ends does not count; parallel edges count once. Graphs
    without an edge have no row.
    """
    spark = edges.sparkSession
    at = f"{shared_folder(spark)}/betweenness-{uuid.uuid4().hex}"
    files = Files(spark, at)
    pairs = written(edges.select(F.col("source_id").alias("v"), F.col("target_id").alias("w")).dropna().where("v != w").distinct(), "edges", at)
    loops = edges.select("source_id", "target_id").dropna().where("source_id = target_id").select(F.col("source_id").alias("node"))
    nodes = written(pairs.select(F.explode(F.array("v", "w")).alias("node")).unionByName(loops).distinct(), "nodes", at)
    n = nodes.count()
    chosen, share, error = nodes, 1.0, 0.0
    if pivots is not None and pivots < n:
        chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
        share, error = n / pivots, math.sqrt(math.log(2 * n / (1 - confidence)) / (2 * pivots))
    core, below, rounds = _without_ends(pairs, at)
    # a source without an edge out lies on no path of its own
    sources = chosen.join(core.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    total = sources.count()
    batches = -(-total // batch)
    dealt = written(sources.select("node", F.pmod(F.xxhash64("node"), F.lit(max(batches, 1))).alias("b")), "sources", at)
    sums = spark.createDataFrame([], "v string, share double, reach long")
    for b in range(batches):
        within = f"{at}/batch-{b}"
        sums = sums.unionByName(written(_dependencies(core, below, dealt.where(F.col("b") == b).select(F.col("node").alias("s")), within), "part", at))
        files.delete(within)
    sums = sums.groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("share"), F.sum("reach").alias("reach"))
    if rounds:
        sums = _with_ends(written(sums, "core", at), rounds, None if chosen is nodes else chosen, at)
    pairs_between = (n - 1) * (n - 2) if n > 2 else 1
    found = nodes.join(sums, "node", "left")
    result = written(found.select("node", (F.coalesce("share", F.lit(0.0)) / F.lit(float(pairs_between)) * share).alias("betweenness"), F.lit(error).alias("error")), "betweenness")
    files.delete(at)
    return result


def _without_ends(pairs: DataFrame, at: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(edges that are left, (node, below): how many nodes were taken off below a node, by round (node, parent, below) of what was)."""
    below = pairs.sparkSession.createDataFrame([], "node string, below double")
    rounds, edges = [], pairs.count()
    while edges:
        single = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("parent")).where("n = 1")
        ends = single.join(pairs.select(F.col("v").alias("w")).distinct(), "w", "left_anti").select(F.col("w").alias("node"), "parent")
        ends = written(ends.join(below, "node", "left").select("node", "parent", F.coalesce("below", F.lit(0.0)).alias("below")), "ends", at)
        taken = ends.count()
        if not taken:
            break
        rounds.append(ends)
        gained = ends.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("below") + 1).alias("below"))
        below = written(below.unionByName(gained).groupBy("node").agg(F.sum("below").alias("below")), "below", at)
        pairs = written(pairs.join(ends.select(F.col("node").alias("w")), "w", "left_anti").select("v", "w"), "edges", at)
        enough, edges = taken * LEAST_TAKEN >= edges, edges - taken
        if not enough:
            break
    return pairs, below, rounds


def _with_ends(core: DataFrame, rounds: list[DataFrame], chosen: DataFrame | None, at: str) -> DataFrame:
    """(node, share) of the nodes of ``core`` (node, share, reach) and of those that the rounds took off, the last first.

    Whatever reaches a parent, and the parent if it is a source, reaches its end. Nodes with nothing below them have no share.
    """
    shares, reach = core.select("node", "share"), core.select("node", "reach")
    for ends in reversed(rounds):
        inner = ends.where("below > 0").join(reach.withColumnsRenamed({"node": "parent", "reach": "_r"}), "parent", "left")
        if chosen is None:
            own = F.lit(1)
        else:
            inner, own = inner.join(chosen.select(F.col("node").alias("parent"), F.lit(1).alias("_own")), "parent", "left"), F.coalesce("_own", F.lit(0))
        inner = written(inner.select("node", "below", (F.coalesce("_r", F.lit(0)) + own).cast("long").alias("reach")), "inner", at)
        reach = reach.unionByName(inner.select("node", "reach"))
        shares = shares.unionByName(inner.select("node", (F.col("reach") * F.col("below")).alias("share")))
    return shares


def _dependencies(pairs: DataFrame, below: DataFrame, sources: DataFrame, within: str) -> DataFrame:
    """(v, share, reach): what the shortest paths from ``sources`` (s) to all other nodes, and to those ``below`` (node, below)
    them, depend on v, over all of them, and how many sources reach v."""
    levels = [written(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "level", within)]
    met = levels[0].select("s", "v")
    while True:
        reached = levels[-1].join(pairs, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        fresh = written(reached.join(met, ["s", "v"], "left_anti"), "level", within)
        if fresh.isEmpty():
            break
        levels.append(fresh)
        met = met.unionByName(fresh.select("s", "v"))
    hung = below.select(F.col("node").alias("v"), "below")
    shares, after = sources.select(F.col("s").alias("v"), F.lit(0.0).alias("share")).limit(0), None
    for level in reversed(levels[1:]):
        own = level.join(hung, "v", "left").withColumn("share", F.coalesce("below", F.lit(0.0))).select("s", "v", "paths", "share")
        if after is not None:
            after = after.select("s", F.col("v").alias("w"), F.col("paths").alias("_p"), F.col("share").alias("_d"))
            flow = level.join(pairs, "v").join(after, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("_p") * (1 + F.col("_d"))).alias("_f"))
            own = own.join(flow, ["s", "v"], "left").select("s", "v", "paths", (F.col("share") + F.coalesce("_f", F.lit(0.0))).alias("share"))
        after = written(own, "shares", within)
        shares = shares.unionByName(after.select("v", "share"))
    return shares.groupBy("v").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("reach"))
