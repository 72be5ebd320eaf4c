"""Lloyd's centroid clustering over integer vectors, assigned by exponion search.

A vector carries an upper bound of the distance to its own centroid and a lower bound of the distance to all others. While
the upper one is the smaller, nothing is computed; else only the centroids in a ball around its centroid are scanned,
whose radius is twice the distance to it and the distance from it to the next centroid. The ball holds the two nearest
centroids of the vector, those at the same distance included, for the radius is inclusive. Candidates are read off a list
of all centroids by distance, kept for each centroid, in lengths of powers of two.

Distances are exact integers; bounds are doubles, moved outward by more than their rounding error. Between rounds the
vectors with their bounds are a written table; the driver holds the centroids alone (k x dimension), and the sums of a
round reach it as one row for each centroid and component. No step groups the vectors, so one that is very common is
no heavier than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, discard, sha256_hex, written

SCALE = 256
LIMIT = 1 << 26  # components are held within +-LIMIT, so that a squared distance of 64 of them fits a long
SLACK = 1e-12  # relative error that bounds allow for
LONG_MAX = (1 << 63) - 1
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long"


def quantised(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, x) of the vectors with ``dimension`` components, all of them finite: floor(SCALE * component), within LIMIT."""
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    number = lambda v: F.floor(F.greatest(F.least(SCALE * v.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    return vectors.where((F.size("embedding") == dimension) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", number).alias("x"))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``: a column for each of the latter."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        apart = x - one
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


class Centroids:
    """The centroids of a round with the lists that a search reads."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        apart = np.sqrt(_squared(c, c).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.near = np.take_along_axis(apart, self.order, axis=1) * (1 - SLACK)
        others = apart + np.diag(np.full(k, np.inf))
        self.next = others.min(axis=1) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((c - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.moved = moved
        self.most_moved = np.array([np.delete(moved, j).max() if k > 1 else 0.0 for j in range(k)])

    def scan(self, x: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``candidates``: the nearest one (of equals the smallest number), its squared distance, and that of the second."""
        candidates = np.sort(candidates)
        d = _squared(x, self.c[candidates])
        best = d.argmin(axis=1)
        rows = np.arange(len(x))
        first = d[rows, best]
        second = np.full(len(x), np.inf)
        if len(candidates) > 1:
            d[rows, best] = np.iinfo(np.int64).max
            second = d.min(axis=1).astype(float)
        return candidates[best], first, second

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measure: bool) -> tuple[np.ndarray, ...]:
        """The arrays of a batch after this round, and the squared distances of those rows for which they were computed
        (all, with ``measure``; else -1)."""
        cluster, upper = cluster.copy(), upper * (1 + SLACK) + self.moved[cluster]
        lower, distance = lower * (1 - SLACK) - self.most_moved[cluster], np.full(len(x), -1, np.int64)
        bound = np.maximum(lower, self.next[cluster] * (0.5 - SLACK))
        open_ = np.arange(len(x)) if measure else np.flatnonzero(upper >= bound)
        apart = x[open_] - self.c[cluster[open_]]
        distance[open_] = np.einsum("ij,ij->i", apart, apart)
        upper[open_] = np.sqrt(distance[open_].astype(float)) * (1 + SLACK)
        open_ = open_[upper[open_] >= bound[open_]]
        radius = (2 * upper[open_] + self.next[cluster[open_]]) * (1 + SLACK)
        for own in np.unique(cluster[open_]):
            rows, reach = open_[cluster[open_] == own], radius[cluster[open_] == own]
            sizes = np.searchsorted(self.near[own], reach, side="right")
            steps = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
            for step in np.unique(steps):
                part = rows[steps == step]
                cluster[part], distance[part], second = self.scan(x[part], self.order[own][: 1 << step])
                upper[part], lower[part] = np.sqrt(distance[part].astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return cluster, upper, lower, distance

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        cluster, distance, second = self.scan(x, np.arange(len(self.c)))
        return cluster, np.sqrt(distance.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK), distance


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def _assigned(state: DataFrame, centroids: Centroids, dimension: int, measure: bool) -> DataFrame:
    known = "cluster" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            bounds = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)] if known else []
            got = centroids.assign(x, *bounds, measure) if known else centroids.first(x)
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64())
            made = [pa.array(a, type=t) for a, t in zip(got, kinds)]
            names = ["vec_id", "x", "cluster", "upper", "lower", "distance"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), *made], names=names)

    columns = ["vec_id", "x", "cluster", "upper", "lower"] if known else ["vec_id", "x"]
    return state.select(*columns).mapInArrow(run, STATE)


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means; those without a vector stay."""
    k, dimension = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            np.add.at(total, cluster, _matrix(batch.column(1), dimension))
            n += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(n)
        sums = pa.array([total[j].tolist() for j in own], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own], pa.int64()), sums], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i")
    out = c.copy()
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():  # k x dimension rows
        out[r.cluster, r.i] = int(r.v) // r.n
    return out


def _start(rows: DataFrame, k: int, seed: str, n: int) -> list[list[int]]:
    """The vectors of the k rows with the smallest hashes, in their order.

    Only rows under a bound of the hash, some hundreds however many ``n`` are, reach the last step, equal rows as one
    with their number; where these are too few, all rows do.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    bound = (4 * k + 200) * (1 << 40) // max(1, n)
    hashed = rows.select(h.alias("h"), "vec_id", "x")
    for some in ([hashed.where(F.col("h") < f"{bound:010x}")] if bound < 1 << 40 else []) + [hashed]:
        found = some.groupBy("h", "vec_id", "x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
        start = [r.x for r in found for _ in range(min(r.n, k))][:k]
        if len(start) == k:
            break
    return start


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, embedding) that are kept.

    Starts from the k kept vectors with the smallest sha256 of ``seed:vec_id``, in that order; after ``rounds`` rounds of
    assignment and exact floored means the vectors are assigned once more. Distances are squared; of equal ones the smaller
    number wins.

    A vector is kept if it has ``dimension`` components, none null, NaN or infinite; a null array is not kept. Components
    beyond LIMIT / SCALE (262,144) are held at that. Repeated rows are rows of their own, and may start as equal
    centroids, of which the later ones stay empty. A null id counts as the last of all when centroids are chosen. With fewer
    than k kept vectors there are as many centroids; without any there is no row. Other columns are not read. Inertias
    beyond a long are given as the largest long.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = quantised(vectors, dimension)
    start = _start(rows, k, seed, vectors.count())
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array(start, np.int64)
    before, state = None, rows
    for at in range(rounds + 1):
        last = at == rounds
        made = written(_assigned(state, Centroids(c, before), dimension, last), "clusters")
        if at:
            discard(state)
        state = made
        if not last:
            before, c = c, _moved(state, c)
    by = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    whole = min(sum(by.values()), LONG_MAX)
    facts = [(j, min(d, LONG_MAX), whole, sha256_hex(",".join(map(str, c[j])).encode())) for j, d in by.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
