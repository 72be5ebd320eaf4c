"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import salted_join, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of ``edges`` (a, b): the root is the smallest id of the component. Edges from a vertex to itself, and
    those with a null end, count as none; without edges there is no row.

    Rounds of hooking each vertex to its smallest neighbour, pointer jumping and contraction of the edges between
    roots: the number of vertices at least halves in each round. All tables stay distributed and are written in
    the shared folder between steps; each step's aggregates are combined before they are shuffled, and the many rows of
    a hub are salted in the joins.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        tree = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("p")), "tree")
        while True:
            up = tree.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = written(salted_join(tree, up, "p", "v").select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), "tree")
            tree = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        roots = tree.select(F.col("v").alias("root"), F.col("p").alias("to"))
        labels = tree.select("v", F.col("p").alias("root")) if labels is None else salted_join(labels, roots, "root", "v", "left").select("v", F.coalesce("to", "root").alias("root"))
        a, b = tree.select(F.col("v").alias("a"), F.col("p").alias("ra")), tree.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        half = written(salted_join(edges, a, "a", "b"), "edges")
        edges = written(salted_join(half, b, "b", "a").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        labels = written(labels, "labels")
