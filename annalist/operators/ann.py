"""Approximate nearest vectors: coarse lists, product-quantised codes, filtered probing and exact re-ranking.

``build`` learns two things from a sample of SAMPLE vectors at most, on the driver: the centres of the lists, and for each
of ``parts`` stretches of the components the codewords of what a vector differs by from its centre. Every vector is then
coded, in its list, by one byte a stretch. A search scores the codes of the lists nearest to a query by tables of its
distances to all codewords, keeps the best, and ranks those by their exact cosine similarities. Vectors are taken at unit
length, so distances and cosines agree; a vector of zeros has no cosine and is in no list.

The exact scan is ``search.vector_search``; it also answers a query that a filter leaves with too few hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.operators.search import cosine

SAMPLE = 20_000  # vectors that centres and codewords are learnt from, those with the smallest hashed ids
WORDS = 256  # codewords of a stretch: one byte
ROUNDS = 12  # of k-means
QUERIES = 500  # that one pass over the codes answers
KEPT = 8  # candidates that are ranked exactly, for each hit that is asked for


@dataclass
class Model:
    """What a search needs besides the codes: centres (lists x dimension) and codewords (parts x WORDS x stretch)."""

    centres: np.ndarray
    words: np.ndarray

    def save(self, spark: SparkSession, at: str) -> None:
        flat = lambda kind, a: [(kind, i, [float(x) for x in row.ravel()]) for i, row in enumerate(a)]
        rows = flat("centre", self.centres) + flat("words", self.words)
        spark.createDataFrame(rows, "kind string, i int, v array<double>").coalesce(1).write.parquet(at)

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> Model:
        rows = sorted((r.kind, r.i, r.v) for r in spark.read.parquet(at).collect())
        centres = np.array([v for kind, _, v in rows if kind == "centre"])
        words = [v for kind, _, v in rows if kind == "words"]
        return cls(centres, np.array(words).reshape(len(words), -1, centres.shape[1] // len(words)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(axis=1) - 2 * x @ c.T  # up to a constant of each row


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _apart(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def proper(vectors: DataFrame, dimension: int) -> DataFrame:
    """The rows with ``dimension`` components, all finite and some of them no zero."""
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where((F.size("embedding") == dimension) & finite & F.exists("embedding", lambda v: v != 0))


def learn(vectors: DataFrame, lists: int, parts: int, id_col: str = "id") -> Model:
    """The model of ``vectors`` (id, embedding) of the dimension that most have, which ``parts`` divides; deterministic for the same rows."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        raise ValueError("there are no vectors to learn from")
    rows = proper(vectors, sizes.n).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(rows):
        raise ValueError("there are no vectors to learn from")
    x = _unit(rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1))
    rng = np.random.default_rng(0)
    centres = _k_means(x, lists, rng)
    rest = x - centres[_apart(x, centres).argmin(axis=1)]
    words = []
    for part in np.split(rest, parts, axis=1):
        c = _k_means(part, WORDS, rng)
        words.append(np.concatenate([c, np.repeat(c[:1], WORDS - len(c), axis=0)]))
    return Model(centres, np.array(words))


def encode(vectors: DataFrame, model: Model, id_col: str = "id") -> DataFrame:
    """(id, list, code) of every vector of the model's dimension that is no zero; other columns stay out."""
    dimension = model.centres.shape[1]
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension))
            own = _apart(x, model.centres).argmin(axis=1)
            rest = np.split(x - model.centres[own], len(model.words), axis=1)
            codes = np.stack([_apart(r, w).argmin(axis=1) for r, w in zip(rest, model.words)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    return proper(vectors, dimension).select(F.col(id_col).alias("id"), "embedding").mapInArrow(run, f"id {kind}, list int, code binary")


def build(vectors: DataFrame, at: str, lists: int = 64, parts: int = 16, id_col: str = "id") -> tuple[Model, DataFrame]:
    """Learn, code and store under ``at``; a folder a list, so that a search reads the lists it probes."""
    model = learn(vectors, lists, parts, id_col)
    model.save(vectors.sparkSession, f"{at}/model")
    encode(vectors, model, id_col).repartition("list").write.partitionBy("list").parquet(f"{at}/codes")
    return load(vectors.sparkSession, at)


def load(spark: SparkSession, at: str) -> tuple[Model, DataFrame]:
    return Model.load(spark, f"{at}/model"), spark.read.parquet(f"{at}/codes")


def _probed(model: Model, codes: DataFrame, asked: list[tuple], keep: int, probes: int) -> DataFrame:
    """(q, id, apart): the best ``keep`` codes of each query of ``asked`` (number, vector) by their approximate distances."""
    q = _unit(np.array([v for _, v in asked], float))
    near = np.argsort(_apart(q, model.centres), axis=1, kind="stable")[:, :probes]
    by_list: dict[int, list[int]] = {}
    for i, row in enumerate(near):
        for j in row:
            by_list.setdefault(int(j), []).append(i)
    kind = codes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        parts = np.arange(len(model.words))
        for batch in batches:
            ids, lists = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, len(parts))
            for j in np.unique(lists):
                rows = np.flatnonzero(lists == j)
                for i in by_list.get(int(j), ()):
                    rest = np.split(q[i] - model.centres[j], len(parts))
                    table = np.stack([((w - r) ** 2).sum(axis=1) for w, r in zip(model.words, rest)])
                    apart = table[parts, code[rows]].sum(axis=1)
                    first = np.argpartition(apart, keep - 1)[:keep] if len(apart) > keep else np.arange(len(apart))
                    held = best.setdefault(i, [])
                    held.extend(zip(apart[first].tolist(), ids[rows[first]].tolist()))
                    if len(held) > 4 * keep:
                        best[i] = sorted(held)[:keep]
        rows = [(asked[i][0], k, d) for i, held in best.items() for d, k in sorted(held)[:keep]]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, codes_type), pa.array(c, pa.float64())], names=["q", "id", "apart"])

    from pyspark.sql.pandas.types import to_arrow_type

    codes_type = to_arrow_type(codes.schema["id"].dataType)
    wanted = codes.where(F.col("list").isin(*by_list)).select("id", "list", "code")
    found = wanted.mapInArrow(run, f"q int, id {kind}, apart double")
    order = W.partitionBy("q").orderBy("apart", "id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def search(model: Model, codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 16, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): up to ``k`` of ``vectors`` (id, embedding) for each of ``queries`` (query_id, embedding), by cosine.

    ``allowed`` (id) narrows the codes before they are scored. A query that finds fewer than ``k`` of the allowed ones is
    answered by all lists, so a narrow filter costs time and no hits. Queries are read in slices of QUERIES, a pass over
    the probed lists for each; those of another dimension, or of zeros, have no hits.
    """
    spark, dimension, out = queries.sparkSession, model.centres.shape[1], None
    narrowed = codes if allowed is None else codes.join(allowed.select("id"), "id", "left_semi")
    known = vectors.select("id", F.col("embedding").alias("_e"))
    key = queries.schema["query_id"].dataType.simpleString()
    for part in _slices(proper(queries, dimension).select("query_id", "embedding").toLocalIterator()):
        asked = [(i, list(r.embedding)) for i, r in enumerate(part)]
        names = F.broadcast(spark.createDataFrame([(i, r.query_id, list(r.embedding)) for i, r in enumerate(part)], f"q int, query_id {key}, _q array<double>"))
        hits = _probed(model, narrowed, asked, KEPT * k, min(probes, len(model.centres)))
        if allowed is not None:
            full = {r.q for r in hits.groupBy("q").count().where(F.col("count") >= k).collect()}
            if short := [a for a in asked if a[0] not in full]:
                every = _probed(model, narrowed, short, KEPT * k, len(model.centres))
                hits = hits.where(F.col("q").isin(*full)).unionByName(every) if full else every
        scored = hits.join(known, "id").join(names, "q").select("query_id", "q", "id", cosine(F.col("_e"), F.col("_q")).alias("score"))
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        found = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query_id", "id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {key}, id {codes.schema['id'].dataType.simpleString()}, score double")


def _slices(rows: Iterator) -> Iterator[list]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == QUERIES:
            yield part
            part = []
    if part:
        yield part
