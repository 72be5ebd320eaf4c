"""MinHash near-dedup with DartMinHash signatures.

A text is the set of its five-word shingles (lower-cased word runs). Hashed darts fall on the regions (weight by
rank) of each shingle, the same darts for the same shingle in every text; darts under the shingle's weight and under a
rank limit count, each belongs to one coordinate of the signature, and a coordinate keeps its earliest dart. The
number of darts looked at is about k ln k whatever the length of the text, and two texts agree in a coordinate with the
probability of their (weighted) Jaccard similarity. Bands of coordinates are buckets of candidates.

Texts with equal shingle sets collapse into one class before anything else. In a bucket every member is compared with
the bucket's smallest member; in buckets that still hold more than one component the members outside the largest one
are compared by signature, in blocks, with all members of other components, and those above a margin verified, so
that no bucket needs a cap, copies are never expanded into pairs, and a large group with few strangers in its bucket
costs in proportion to its size. Joins on buckets, leaders and copies salt the keys that hold many rows. Every candidate is verified by the Jaccard similarity of the whole shingle sets (32-bit
hashes). With 36 bands of 7 coordinates a pair at similarity 0.8 is missed with probability 2e-4.

Defined results: a null or empty text, or one without words, is a class of its own; a text of fewer than five words is
one shingle; a row without an id has the class of the rows with its text, or none; rows that share an id share a class; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored by ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, mix64, salted_join, written
from annalist.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
MARGIN = 0.1  # below the similarity, four standard deviations of a signature's estimate
BLOCK = 1024  # members of one block of a bucket that holds several components
FILTER_BITS = 1 << 22  # of the bounded bitmap that keeps shingle sets of non-candidates from being written

_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# cumulative probabilities of a Poisson variable of mean 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


class Shingler:
    """Distinct 64-bit shingle hashes of texts; remembers word hashes."""

    LIMIT = 100_000

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = _WORD.findall(text.lower())
        memo = self.memo
        if len(memo) > self.LIMIT:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = zlib.crc32(t.encode()) << 32 | zlib.adler32(t.encode())
        ids = mix64(np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens)))
        k = min(self.words, len(ids))
        if not k:
            return ids
        h = ids[: len(ids) - k + 1].copy()
        for i in range(1, k):
            h = h * _GOLD + ids[i : len(ids) - k + 1 + i]
        return np.unique(mix64(h))


def dart_minhash(items: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k signature values of a weighted set of 64-bit items (weights are 1 unless given)."""
    weights = np.ones(len(items)) if weights is None else np.asarray(weights, float)
    total = weights.sum()
    goal = k * (math.log(k) + 2)
    while True:
        limit = goal / total  # of the ranks looked at
        found = [_darts(items, weights, band, limit) for band in range(max(0, math.ceil(math.log2(max(weights.max(), 1)))) + 1)]
        dart, rank = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        place = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[place[order]] = dart[order]  # the last write is the earliest dart
        hit[place] = True
        if hit.all():
            return mix64(out)
        goal *= 2


def _darts(items: np.ndarray, weights: np.ndarray, band: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Accepted darts and their ranks in one dyadic band of weights, cut into cells of area one."""
    low, width = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
    keep = weights > low
    x, w = items[keep], weights[keep]
    cells = math.ceil(limit * width)
    seeds = mix64(np.arange(cells, dtype=np.uint64) * _GOLD + np.uint64(band << 40) + np.uint64(1))
    region = mix64(x[:, None] ^ seeds[None, :]).ravel()
    n = np.searchsorted(_POISSON, (region >> np.uint64(11)).astype(float) * 2.0**-53, "right")
    at = np.repeat(np.arange(len(region)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix64(region[at] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
    rank = (at % cells + (mix64(dart ^ _GOLD) >> np.uint64(11)).astype(float) * 2.0**-53) / width
    ok = rank < limit
    if band or w.min(initial=1.0) < 1:
        height = low + width * (mix64(dart + _GOLD) >> np.uint64(11)).astype(float) * 2.0**-53
        ok &= height < w[at // cells]
    return dart[ok], rank[ok]


def signatures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands, sig): digest of the shingle set, hashes of the bands, and one byte of each coordinate."""

    def run(batches):
        shingle = Shingler()
        mult = mix64(np.arange(1, rows + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
        salt = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(7))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, hashes, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle(text or "")
                    if not len(s):
                        keys.append(None), hashes.append(None), sigs.append(None)
                        continue
                    sig = dart_minhash(s, bands * rows)
                    keys.append(mix64(np.array([s.sum(), (s * mult[0]).sum() ^ mix64(s ^ mult[1]).sum(), len(s)], np.uint64)).tobytes())
                    hashes.append(mix64((sig.reshape(bands, rows) * mult).sum(1) ^ salt).view(np.int64))
                    sigs.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "key", "bands", "sig"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, key binary, bands array<long>, sig binary")


def _slot(id_col):
    return F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)).cast("int")


def shingle_sets(ids: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set) of the shingle sets, as sorted 32-bit hashes, of at least the documents in ``ids`` (id).

    Sets are made again from the texts, but only for candidates: a bitmap of FILTER_BITS bits over hashed ids, the same
    size whatever the data, drops most others before anything is written; the joins with the result are exact.
    """
    slots = ids.select(_slot(F.col("id")).alias("s")).distinct()
    bits = np.zeros(FILTER_BITS, bool)
    bits[slots.toArrow()["s"].to_numpy()] = True  # at most FILTER_BITS small rows
    bitmap = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches):
        shingle, known = Shingler(), np.unpackbits(bitmap.value).view(bool)
        for batch in batches:
            wanted = batch.filter(pa.array(known[batch.column(2).to_numpy()]))
            for at in range(0, wanted.num_rows, 256):
                part = wanted.slice(at, 256)
                out = [np.unique((shingle(t or "") >> np.uint64(32)).astype(np.uint32)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "set"])

    keyed = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"), _slot(F.col(id_col).cast("long"))).where("id is not null")
    return written(keyed.mapInArrow(sets, "id long, set binary"), "shingles")


def _jaccard(x: bytes, y: bytes) -> float:
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verify(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose shingle sets have at least that Jaccard similarity, with it."""

    def jaccard(batches):
        for batch in batches:
            got = [_jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"])

    sides = pairs.join(found.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sides = salted_join(sides, found.select(F.col("id").alias("a"), F.col("set").alias("x")), "a", "b", counts=counts, total=pairs.count())
    return sides.select("a", "b", "x", "y").mapInArrow(jaccard, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def _mixed_links(members: DataFrame, need: int, similarity: float) -> DataFrame:
    """Verified links between different components that share a bucket: in each group a spanning forest of them.

    ``members`` has (h, rep, root, large, n_large, n_rest, sig, set) of the buckets with more than one component:
    the root of the bucket's largest component, its members and the others. Pairs whose signatures agree in ``need``
    coordinates or more are verified where they are found, and a link is given only if it joins what no earlier link
    of the group has joined. Both parts are dealt into blocks of about BLOCK, numbered below zero for the largest
    component. Each pair of blocks but those of the largest component is a group of its own, so no group grows with a
    bucket.
    """
    blocks, rests = F.ceil(F.col("n_large") / BLOCK).cast("int"), F.ceil(F.col("n_rest") / BLOCK).cast("int")
    is_large, code = F.col("root") == F.col("large"), F.xxhash64("rep")
    own = F.when(is_large, -1 - F.pmod(code, blocks)).otherwise(F.pmod(code, rests)).cast("int")
    other = F.sequence(F.when(is_large, 0).otherwise(-blocks), rests - 1)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "root", "sig", "set")

    def compare(table: pa.Table) -> pa.Table:
        rep, root, own = (table[c].to_numpy() for c in ("rep", "root", "own"))
        sig, sets = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(rep), -1), table["set"]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        links = []
        for x in left.tolist():
            y = right[(root[right] != root[x]) & ((rep[right] > rep[x]) | (i != j))]
            same = (sig[y] == sig[x]).sum(1)
            for k in np.argsort(-same, kind="stable").tolist():
                if same[k] < need:
                    break
                to = int(y[k])
                p, q = top(int(root[x])), top(int(root[to]))
                if p != q and _jaccard(sets[x].as_py(), sets[to].as_py()) >= similarity:
                    above[max(p, q)] = min(p, q)
                    links.append((int(min(rep[x], rep[to])), int(max(rep[x], rep[to]))))
        return pa.table({"a": pa.array([k[0] for k in links], pa.int64()), "b": pa.array([k[1] for k in links], pa.int64())})

    return dealt.groupBy("h", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row: the class is the connected component of near-duplicates, named by its smallest id."""
    bounded_batches(documents.sparkSession)
    signed = written(signatures(documents, id_col, text_col, bands, rows), "signatures")
    # texts of one key have one signature: any of them will do
    reps = written(signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "texts")
    banded = reps.select("rep", F.explode("bands").alias("h"))
    leaders = banded.groupBy("h").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("leader < last")
    leaders = written(leaders.select("h", "leader", "n"), "leaders")  # of buckets with two texts or more
    members = salted_join(banded, leaders.select("h", "leader"), "h", "rep", counts=leaders.select("h", "n"), total=reps.count() * bands)
    members = written(members.select("h", "rep", "leader"), "members")
    tried = written(members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sets = shingle_sets(tried.select(F.explode(F.array("a", "b")).alias("id")), documents, id_col, text_col)
    links = written(verify(tried, sets, similarity).select("a", "b"), "links")
    roots = written(components(links), "roots")
    rooted = written(members.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("h", "rep", F.coalesce("root", "rep").alias("root")), "rooted")
    parts = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("h").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    several = written(several.select("h", F.col("top.root").alias("large"), F.col("top.n").alias("n_large"), (F.col("n") - F.col("top.n")).alias("n_rest"), "n"), "several")
    mixed = salted_join(rooted, several.drop("n"), "h", "rep", counts=several.select("h", "n"))
    mixed = written(mixed.join(reps.select("rep", "sig"), "rep").join(sets.select(F.col("id").alias("rep"), "set"), "rep"), "mixed")
    more = written(_mixed_links(mixed, int((similarity - MARGIN) * bands * rows), similarity), "links")
    if not more.isEmpty():
        roots = written(components(links.union(more)), "roots")
    named = reps.select("key", "rep").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    named = written(named, "classes")
    worded = salted_join(signed.where("key is not null").select("doc_id", "key"), named, "key", "doc_id", "left", counts=reps.select("key", "n"), total=signed.count())
    alone = signed.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return worded.select("doc_id", F.coalesce("root", "doc_id").alias("class_id")).union(alone)


def keep(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` whose id names their class: one document of each class. Rows without an id stay."""
    taken, name = {c.lower() for c in documents.columns}, "gone"
    while name in taken:
        name += "_"
    gone = written(classes(documents, id_col, text_col, similarity).where("class_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return documents.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
