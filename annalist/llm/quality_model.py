"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Tokens are runs of word characters and runs of punctuation, lower-cased, with a mark for shouting. Uni- and
bigrams are hashed into 2^BITS buckets; a text is the vector of log-scaled counts, scaled to unit length, and
its score the logistic of a sparse dot product. FTRL-Proximal (per-coordinate rates, L1 and L2) runs over a
bounded sample of the labelled rows: the SAMPLE rows with the smallest hashed ids, so the same labels always give
the same model. Everything else, above all scoring, covers whole texts of all rows.

Defined results: a null text counts as empty and scores the bias; rows with a null id or label never train; an
id labelled more than once trains once per label; with labels of one class or none the score is the share of
ones (0.5 without labels); an empty table gives an empty result; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, mix64

BITS = 18
SAMPLE = 6000  # documented bound on the labelled rows that train
EPOCHS = 8
THRESHOLD = 0.3

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Memo of token hashes; emptied when it holds LIMIT tokens."""

    LIMIT = 100_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shout = len(token) > 1 and token.isupper()
        got = self[token] = zlib.crc32(token.lower().encode()) + (shout << 32)
        return got


def features(text: str, memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and unit-length weights of a text's uni- and bigrams."""
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    one = mix64(ids + np.uint64(1))
    grams = np.concatenate([one, mix64(one[:-1] * _PAIR + one[1:])]) if len(one) else one
    buckets, counts = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    weights = np.log1p(counts)
    return buckets, (weights / max(np.sqrt((weights**2).sum()), 1e-12)).astype(np.float32)


class Ftrl:
    """FTRL-Proximal for logistic loss; the bias is not regularised."""

    def __init__(self, alpha=1.0, beta=1.0, l1=0.1, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.z0 = self.n0 = 0.0

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.z0 / ((self.beta + self.n0**0.5) / self.alpha)

    def learn(self, buckets, values, label) -> None:
        z, n = self.z[buckets], self.n[buckets]
        w = self._weights(z, n)
        p = 1 / (1 + np.exp(-np.clip(w @ values + self.bias, -35, 35)))
        g = (p - label) * values
        self.z[buckets] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[buckets] = n + g * g
        g0 = p - label
        self.z0 += g0 - ((self.n0 + g0 * g0) ** 0.5 - self.n0**0.5) / self.alpha * self.bias
        self.n0 += g0 * g0

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def _rows(df: DataFrame, text_col: str, keep: list[str]):
    """Rows (kept columns, buckets, values) of the texts of ``df``."""

    def run(batches):
        memo = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [features(t or "", memo) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                    names=[*keep, "buckets", "values"],
                )

    schema = ", ".join(f"{c} long" for c in keep) + ", buckets array<int>, values array<float>"
    return df.select(*(F.col(c).cast("long").alias(c) for c in keep), F.col(text_col).cast("string")).mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from at most ``sample`` rows of ``labels`` (id, label 0 or 1).

    The sample's ids are broadcast to find their texts: at most ``sample`` rows of two integers.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    texts = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = _rows(texts.join(F.broadcast(chosen), "_id"), "_text", ["_id", "_label"]).toArrow()
    order = np.lexsort([found["_label"].to_numpy(), found["_id"].to_numpy(), mix64(found["_id"].to_numpy())])
    label = found["_label"].to_numpy()
    share = float(label.mean()) if len(label) else 0.5
    if not 0 < share < 1:
        return np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))) if len(label) else 0.0
    rows = [(found["buckets"][i].values.to_numpy(), found["values"][i].values.to_numpy().astype(float), float(label[i])) for i in order.tolist()]
    model, rng = Ftrl(), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            model.learn(*rows[i])
    return model.weights(), model.bias


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; the weights are broadcast: 2^BITS floats (1 MB), whatever the data."""
    weights, bias = documents.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches):
        memo, w = _Hashes(), weights.value
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                buckets, values = features(text or "", memo)
                got.append(1 / (1 + np.exp(-np.clip(float(w[buckets] @ values) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    bounded_batches(documents.sparkSession)
    model = fit(documents, labels.where(~held_out()))
    held = F.coalesce(held_out(), F.lit(False))
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
