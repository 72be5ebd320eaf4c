"""Ranked lexical search: document-sharded postings in compressed rows, with precomputed integer impacts.

An index row is a shard: some thousands of documents with their own dictionary, and for each of its terms the documents
that hold it with the impact of each, all in flat arrays (compressed sparse rows: starts, documents, impacts). A search
scores a shard's documents one query term at a time into a dense accumulator and keeps the best k; those of shards are
merged in a task, then by query over tasks.

The score of a document sums, over the query's terms, repeats included, weight * impact, all in integers:
``weight = floor(1000 * ln((2N + 2) / (2 df + 1)))``, ``impact = (10**9 * tf) // (1000 * tf + 12 * m)`` and
``m = 75 + 25 * n * N // L``, with N documents that have a term, L terms of all documents, n terms of the document and
tf occurrences in it. Impacts need N and L alone, so they are stored; a term's df is gathered from the shards for the
terms that are searched for, and the index is built without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.llm.common import bounded_batches, discard, written

SHARD_DOCS = 1 << 15  # documents of a shard are numbered in 16 bits
SHARD_WORDS = 4_000_000  # terms with repeats at which a shard is closed
QUERY_BYTES = 4 << 20  # query texts that are searched for in one pass over the index
MERGE_GROUPS = 64  # of tasks whose results are merged before all are
INDEX = "n_docs int, n_words long, ids array<long>, terms binary, starts binary, docs binary, impacts binary"
_WORD = bytes(c for c in range(128) if chr(c).isalnum())
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or c in _WORD else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A to Z in lower case."""
    return text.translate(_PLAIN).split()


class _Shard:
    """Postings of the documents that a task has read since the last shard."""

    def __init__(self):
        self.slots: defaultdict = defaultdict()
        self.slots.default_factory = self.slots.__len__
        self.ids, self.sizes, self.widths, self.at, self.tf, self.words = [], [], [], [], [], 0

    def add(self, key, words: list[bytes]) -> None:
        counts = Counter(words)
        self.at.extend(map(self.slots.__getitem__, counts))
        self.tf.extend(counts.values())
        self.widths.append(len(counts))
        self.ids.append(key)
        self.sizes.append(len(words))
        self.words += len(words)

    def row(self) -> tuple:
        """The index row, with counts in place of impacts and the documents' sizes behind it."""
        at = np.array(self.at, np.int32)
        order = np.argsort(at, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.slots)))]).astype("<i4")
        docs = np.repeat(np.arange(len(self.ids), dtype="<u2"), self.widths)[order]
        tf = np.array(self.tf, "<u4")[order]
        return len(self.ids), self.words, self.ids, b" ".join(self.slots), starts.tobytes(), docs.tobytes(), tf.tobytes(), self.sizes


_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of ``docs``; a search takes it again and again.

    A document without a term, as one with a null or an empty text, is in no shard and does not count in N. Equal rows are
    documents of their own, null ids included. The index of an empty table is empty.
    """
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shard = [*_NAMES, "sizes"], _Shard()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py() or b"")
                if words:
                    shard.add(key, words)
                if shard.words >= SHARD_WORDS or len(shard.ids) >= SHARD_DOCS:
                    yield _batch([shard.row()], names)
                    shard = _Shard()
        if shard.ids:
            yield _batch([shard.row()], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    raw = written(rows.mapInArrow(counted, f"{INDEX}, sizes array<long>"), "postings")
    size = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("l")).first()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n_docs, n_words, ids, terms, starts, docs, tf, sizes = (batch.column(c)[i].as_py() for c in range(8))
                m = 75 + 25 * np.array(sizes, np.int64) * size.n // size.l
                tf = np.frombuffer(tf, "<u4").astype(np.int64)
                impacts = (10**9 * tf // (1000 * tf + 12 * m[np.frombuffer(docs, "<u2")])).astype("<u4")
                yield _batch([(n_docs, n_words, ids, terms, starts, docs, impacts.tobytes())], _NAMES)

    index = written(raw.mapInArrow(weighed, INDEX), "index")
    discard(raw)
    return index


def _slices(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(number, id, terms with counts) of all queries, in lists of QUERY_BYTES of text or one longer text."""
    part, held, number = [], 0, 0
    for r in queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        text = bytes(r.text or b"")
        if part and held + len(text) > QUERY_BYTES:
            yield part
            part, held = [], 0
        if words := Counter(terms_of(text)):
            part.append((number, r.id, words))
            held += len(text)
        number += 1
    if part:
        yield part


class _Best:
    """The k best documents of each query so far; of equal scores those with the smallest ids, a null id being the last."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def take(self, query: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        least = self.of[query][0][-1] if query in self.of and len(self.of[query][0]) == self.k else 1
        found = np.flatnonzero(scores >= least)
        if len(found) > self.k:
            kth = scores[found][np.argpartition(scores[found], -self.k)[-self.k :]].min()
            found = found[scores[found] >= kth]  # all that tie with the last one
        if not len(found):
            return
        new = [scores[found], ids[found], null[found]]
        s, i, n = (np.concatenate(x) for x in zip(self.of[query], new)) if query in self.of else new
        order = np.lexsort((i, n, -s))[: self.k]
        self.of[query] = (s[order], i[order], n[order])


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``index`` for each of ``queries``, with a score above 0.

    Equal scores are ranked by ascending doc_id, a null one last. A query without a term, as a null or an empty text, has
    no rows; queries with equal or null ids are queries of their own. Queries are read on the driver in slices of
    QUERY_BYTES, each of which is one pass over the index.
    """
    spark, out = index.sparkSession, None
    bounded_batches(spark)
    key = queries.schema[id_col].dataType.simpleString()
    for part in _slices(queries, id_col, text_col):
        found = _search(index, part, k)
        names = spark.createDataFrame([(q, i) for q, i, _ in part], f"q int, item_id {key}")
        found = found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {key}, rank int, doc_id long, score long")


def _weights(index: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """The weight of each of ``terms`` (by their numbers)."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for n, words, starts in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.diff(np.frombuffer(starts, "<i4"))
                own = [(terms[w], i) for i, w in enumerate(words.split()) if w in terms]
                if own:
                    t, at = np.array(own).T
                    df[t] += wide[at]
                df[-1] += n
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(df[own], pa.int64())], names=["t", "df"])

    counts = index.select("n_docs", "terms", "starts").mapInArrow(held, "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))
    df = np.zeros(len(terms) + 1, np.int64)
    for r in counts.collect():  # a row for each term of the slice
        df[r.t] = r.df
    n = int(df[-1])
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df[:-1]], np.int64)


def _search(index: DataFrame, part: list[tuple], k: int) -> DataFrame:
    terms: dict[bytes, int] = {}
    asked = [(q, [(terms.setdefault(w, len(terms)), n) for w, n in words.items()]) for q, _, words in part]
    shared = index.sparkSession.sparkContext.broadcast((terms, asked, _weights(index, terms)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked, weights = shared.value
        best = _Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                n_docs, words, starts, docs, impacts = (batch.column(c)[i].as_py() for c in (0, 2, 3, 4, 5))
                ids = batch.column(1)[i].values
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                starts, docs, impacts = np.frombuffer(starts, "<i4"), np.frombuffer(docs, "<u2"), np.frombuffer(impacts, "<u4")
                held = {terms[w]: s for s, w in enumerate(words.split()) if w in terms}
                rows = {t: (docs[starts[s] : starts[s + 1]], weights[t] * impacts[starts[s] : starts[s + 1]].astype(np.int64)) for t, s in held.items()}
                for q, own in asked:
                    total = np.zeros(n_docs, np.int64)
                    for t, times in own:
                        if t in rows:
                            at, value = rows[t]
                            total[at] += times * value
                    best.take(q, total, ids, null)
        for q, (s, i, n) in best.of.items():
            kinds = [pa.array([q] * len(s), pa.int32()), pa.array(i, pa.int64(), mask=n), pa.array(s, pa.int64())]
            yield pa.RecordBatch.from_arrays(kinds, names=["q", "doc_id", "score"])

    hits = index.select("n_docs", "ids", "terms", "starts", "docs", "impacts").mapInArrow(scored, "q int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    near = top(hits.withColumn("_g", F.spark_partition_id() % MERGE_GROUPS), "q", "_g").drop("rank", "_g")
    return top(near, "q")
