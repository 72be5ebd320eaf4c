"""Exact removal of repeated byte strings: a byte goes if a LENGTH-byte string over it also starts in an earlier document.

Documents, in the order of their ids, are packed into shards. A string of LENGTH bytes has an anchor: the leftmost of its
GRAM-byte substrings with the smallest hash. Equal strings have equal anchors, so only strings whose anchor is shared can
repeat. Shards first exchange, in sorted blobs by hash range, the pairs (anchor, context) that they hold, where the
context is all that the anchor's strings cover. An anchor with one context everywhere is settled by that: in every
document but the first all its strings repeat. Anchors with several contexts (the edges of copies and passages) are
settled string by string: the regions around them are sorted by suffix within the shard (``engine``), equal strings are
neighbours with a common prefix of LENGTH or more, and one fingerprint of each distinct string is exchanged likewise. The
first shard that holds a string keeps it.

Each shard holds a key at most once, so a string that a third of all documents share is as many rows as there are
shards. Tables between the steps are written in the shared folder; nothing is collected.

Defined results: a null text counts as empty; a row without an id keeps its text and takes none from others; rows that
share an id do not repeat each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, mix64, release, written
from annalist.llm.induced_sort import QUEUE_BYTES, suffix_array

LENGTH = 50
GRAM = 24
SHARD_BYTES = 2 << 20
SHARDS_A_FILE = 8  # that one task packs and writes, about
RANGE_ROWS = 250_000  # anchors of one hash range, about
_BLOCK = 1 << 14
_POS = np.uint64(26)  # bits of a place relative to its block, where windows span the block and a string's length

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Powers of both bases over two blocks; those of whole blocks are kept per shard, so no table is as long as the text.
_LOW, _LOW_INVERSE = _powers(_BASE, 2 * _BLOCK), _powers(_INVERSE, 2 * _BLOCK)


class Hashes:
    """Hashes of all substrings of a text: eight bytes of state for each of its bytes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        blocks = n // _BLOCK + 1
        up = _powers(np.uint64(pow(int(_BASE), _BLOCK, 1 << 64)), blocks)
        self.down = _powers(np.uint64(pow(int(_INVERSE), _BLOCK, 1 << 64)), blocks)
        self.prefix = np.zeros(n + 1, np.uint64)
        for b, at in enumerate(range(0, n, _BLOCK)):
            part = _BYTES[self.data[at : at + _BLOCK]]
            part *= _LOW[: len(part)]
            part *= up[b]
            part[:1] += self.prefix[at : at + 1]
            np.cumsum(part, out=self.prefix[at + 1 : at + 1 + len(part)])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of substrings, equal wherever they stand."""
        return (self.prefix[end] - self.prefix[begin]) * (_LOW_INVERSE[begin % _BLOCK] * self.down[begin // _BLOCK])

    def grams(self, block: int, last: int, gram: int) -> np.ndarray:
        """Hashes of the ``gram``-byte strings that start from the first byte of a block up to ``last``."""
        at = block * _BLOCK
        found = self.prefix[at + gram : last + gram] - self.prefix[at:last]
        found *= _LOW_INVERSE[: last - at]
        found *= self.down[block]
        return mix64(found)


class Shard(Hashes):
    """The texts of one shard, with the anchors of all their LENGTH-byte strings."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes, length: int = LENGTH, gram: int = GRAM):
        super().__init__(data)
        self.ids, self.lengths, self.length = ids, lengths, length
        n, w = len(self.data), length - gram + 1
        self.ends = np.cumsum(lengths)
        self.group = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)  # texts of one id
        self.start = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
        self.h = self.c = np.zeros(0, np.uint64)
        if n < length:
            return
        strings, grams = n - length + 1, n - gram + 1
        if min(_BLOCK + w - 1, grams) > 1 << int(_POS):
            raise ValueError(f"strings of {length} bytes do not fit places of {_POS} bits")
        begins, anchors, before = [], [], -1
        for block, at in enumerate(range(0, strings, _BLOCK)):  # blocks that stay in the cache
            keys = self.grams(block, min(at + _BLOCK + w - 1, grams), gram) >> _POS << _POS
            keys |= np.arange(len(keys), dtype=np.uint64)
            size = 1
            while 2 * size <= w:
                keys = np.minimum(keys[:-size], keys[size:])
                size *= 2
            if size < w:
                keys = np.minimum(keys[: len(keys) - (w - size)], keys[w - size :])
            found = (keys & np.uint64((1 << int(_POS)) - 1)).astype(np.int64) + at
            new = np.flatnonzero(np.diff(found, prepend=before))
            begins.append(new + at)
            anchors.append(found[new])
            before = int(found[-1])
        run, anchor = np.concatenate(begins), np.concatenate(anchors)
        first = self.ends - lengths
        begins = np.union1d(run, first[first < strings])
        doc = np.searchsorted(self.ends, begins, "right")
        last = np.minimum(np.r_[begins[1:], strings] - 1, self.ends[doc] - length)  # strings do not cross texts
        some = last >= begins
        if not some.any():
            return
        self.start, self.last, self.doc = begins[some], last[some], doc[some]
        self.anchor = anchor[np.searchsorted(run, self.start, "right") - 1]
        self.h = mix64(self.hashes(self.anchor, self.anchor + gram)) >> np.uint64(16)
        begin = np.maximum(self.ends[self.doc] - lengths[self.doc], self.anchor - (w - 1))
        end = np.minimum(self.ends[self.doc], self.anchor + length)
        left = mix64((self.anchor - begin).astype(np.uint64) + np.uint64(11))
        right = mix64((end - self.anchor).astype(np.uint64) + np.uint64(977))
        self.c = mix64(self.hashes(begin, end) ^ left ^ right) >> np.uint64(32)

    def covered(self, which: np.ndarray) -> np.ndarray:
        """Whether a string of the anchors marked in ``which`` starts at each byte."""
        edge = np.zeros(len(self.data) + 1, np.int8)  # the ranges of two anchors never overlap
        edge[self.start[which]] = 1
        edge[self.last[which] + 1] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8).view(bool)

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Starts of all strings of the anchors numbered ``which``."""
        n = self.last[which] - self.start[which] + 1
        return np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _fingerprints(text: Hashes, starts: np.ndarray, length: int) -> np.ndarray:
    return mix64(text.hashes(starts, starts + length))


def _spread(mask: np.ndarray, length: int) -> np.ndarray:
    """The bytes that strings of ``length`` bytes cover, given where those start."""
    gone, size = mask.copy(), 1
    while size < length:
        step = min(size, length - size)
        gone[step:] |= gone[:-step].copy()
        size += step
    return gone


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


_SCHEMA = "shard long, kind string, part int, blob binary"
_NAMES = ["shard", "kind", "part", "blob"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=_NAMES)


def _by_range(shard: int, kind: str, keys: np.ndarray, others: list[np.ndarray], bits: int, parts: int):
    """Rows of the sorted ``keys`` cut by their hash range, with what belongs to them."""
    ranges = (keys >> np.uint64(bits - 20)).astype(np.int64) * parts >> 20
    cuts = np.searchsorted(ranges, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[p], cuts[p + 1])
        yield shard, kind, p, b"".join(np.ascontiguousarray(a[at]).tobytes() for a in (keys, *others))


def _packed_shards(documents: DataFrame, id_col: str, text_col: str, n: int, shard_bytes: int) -> DataFrame:
    """One row per shard: ids, lengths and texts of its documents, in the order of ids.

    The ids are dealt to ``n`` ranges by sampled rows; within a range, shards are cut by bytes: before the id whose
    text would take one past ``shard_bytes``. Only texts of one id are never parted. A shard's number is its range
    and its place there.
    """

    def run(batches):
        ids, texts, size, cuts, part = [], [], 0, 0, 0

        def pack():
            lengths = np.array([len(t) for t in texts], np.int64)
            parts = [_pack(np.array(ids, np.int64)), _pack(lengths), zstandard.compress(b"".join(texts), 3)]
            sizes = np.array([len(p) for p in parts[:2]], np.int64).tobytes()
            return _rows([(part << 32 | cuts, "pack", 0, b"".join([sizes, *parts]))])

        for batch in batches:
            for key, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                text = (text or "").encode()
                if ids and key != ids[-1] and size + len(text) > shard_bytes:
                    yield pack()
                    ids, texts, size, cuts = [], [], 0, cuts + 1
                ids.append(key)
                texts.append(text)
                size += len(text)
        if ids:
            yield pack()

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "t").withColumn("shard", F.spark_partition_id().cast("long"))
    return written(dealt.mapInArrow(run, _SCHEMA), "shards")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, lengths and texts of a shard."""
    a, b = np.frombuffer(blob, np.int64, 2).tolist()
    return _unpack(blob[16 : 16 + a], np.int64), _unpack(blob[16 + a : 16 + a + b], np.int64), zstandard.decompress(blob[16 + a + b :])


def _offers(shards: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Distinct (anchor, context) pairs of each shard, by hash range."""

    def run(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                s = Shard(*_unpacked(blob), length, gram)
                order = np.lexsort([s.c, s.h])
                h, c = s.h[order], s.c[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
                yield _rows(list(_by_range(shard, "offer", h[new], [c[new].astype(np.uint32)], 48, parts)))

    return shards.mapInArrow(run, _SCHEMA)


def _answers(offers: DataFrame, second: int, parts: int) -> DataFrame:
    """What every shard must know of each range: keys that an earlier shard holds, and anchors with several contexts.

    ``second`` is the width in bytes of what follows each 8-byte key: 4 for contexts, 0 for strings.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, contexts, shard = [], [], []
        for number, blob in zip(table["shard"].to_pylist(), table["blob"].to_pylist()):
            n = len(blob) // (8 + second)
            keys.append(np.frombuffer(blob, np.uint64, n))
            contexts.append(np.frombuffer(blob, np.uint32, n, 8 * n) if second else np.zeros(n, np.uint32))
            shard.append(np.full(n, number, np.int64))
        h, c, s = np.concatenate(keys), np.concatenate(contexts), np.concatenate(shard)
        order = np.lexsort([s, c, h])
        h, c, s = h[order], c[order], s[order]
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_pair = new_h | np.r_[True, c[1:] != c[:-1]]
        group = np.cumsum(new_h) - 1
        several = (np.bincount(group, new_pair) > 1)[group] & (np.minimum.reduceat(s, np.flatnonzero(new_h)) != np.maximum.reduceat(s, np.flatnonzero(new_h)))[group]
        rows = []
        for kind, keep in (("seen", ~new_pair), ("several", several)):
            at = np.flatnonzero(keep)
            at = at[np.argsort(s[at], kind="stable")]
            numbers, starts = np.unique(s[at], return_index=True)
            for number, part in zip(numbers.tolist(), np.split(at, starts[1:])):
                rows.append((number, kind, 0, h[part].tobytes() + c[part].tobytes() if kind == "seen" else np.unique(h[part]).tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    dealt = offers.repartition(max(1, parts // 4), "part")  # a few ranges a task, whatever the session's default
    return written(dealt.groupBy("part").applyInArrow(run, _SCHEMA), "answers")


def _seen(blobs: list[bytes]) -> np.ndarray:
    """Sorted (key, context) pairs of the answers, mixed into one number each."""
    out = [np.zeros(0, np.uint64)]
    for b in blobs:
        n = len(b) // 12
        out.append(_joined(np.frombuffer(b, np.uint64, n), np.frombuffer(b, np.uint32, n, 8 * n)))
    return np.sort(np.concatenate(out))


def _joined(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(h) + np.uint64(3) * mix64(c.astype(np.uint64) + np.uint64(5))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _later(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows have a key that a smaller group also has."""
    order = np.lexsort([group, keys])
    k, g = keys[order], group[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    out = np.zeros(len(k), bool)
    out[order] = g > np.repeat(g[first], np.diff(np.r_[first, len(k)]))
    return out


def _by_shard(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "shard")


def _settle(shards: DataFrame, answers: DataFrame, parts: int, tasks: int, length: int, gram: int, engine) -> DataFrame:
    """Strings that repeat by their contexts (``covered``), those still open, and distinct open strings by hash range."""

    def run(table: pa.Table) -> pa.Table:
        shard, blobs, seen, several = table["shard"][0].as_py(), {}, [], [np.zeros(0, np.uint64)]
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind == "seen":
                seen.append(blob)
            elif kind == "several":
                several.append(np.frombuffer(blob, np.uint64))
            else:
                blobs[kind] = blob
        if "pack" not in blobs:
            return pa.Table.from_batches([_rows([])])
        s = Shard(*_unpacked(blobs["pack"]), length, gram)
        group, pair = s.group[s.doc], _joined(s.h, s.c)
        covered = _within(pair, _seen(seen)) | _later(pair, group)
        abroad = _within(s.h, np.sort(np.concatenate(several)))
        order = np.lexsort([s.c, s.h])
        h, c = s.h[order], s.c[order]
        new_h = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        varied = np.bincount(np.cumsum(new_h) - 1, new_h | np.r_[True, c[1:] != c[:-1]]) > 1 if len(h) else np.zeros(0, bool)
        home = np.zeros(len(h), bool)
        home[order] = varied[np.cumsum(new_h) - 1] if len(h) else False
        open_anchors = (abroad | home) & ~covered
        mask = s.covered(covered)
        starts = s.strings(np.flatnonzero(open_anchors))
        local, first = engine(s, starts)
        mask[starts[local]] = True
        keys = np.unique(_fingerprints(s, first, length))
        open_mask = np.zeros(len(s.data), bool)
        open_mask[starts[~local]] = True
        rows = [(shard, "covered", 0, _pack(np.packbits(mask))), (shard, "open", 0, _pack(np.packbits(open_mask)))]
        return pa.Table.from_batches([_rows(rows + list(_by_range(shard, "string", keys, [], 64, parts)))])

    rows = _by_shard(shards.unionByName(answers), tasks)
    return written(rows.groupBy("shard").applyInArrow(run, _SCHEMA), "settled")


def _finish(shards: DataFrame, settled: DataFrame, answers: DataFrame, tasks: int, id_col: str, length: int) -> DataFrame:
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(table: pa.Table) -> pa.Table:
        blobs, seen = {}, [np.zeros(0, np.uint64)]
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind == "seen":
                seen.append(np.frombuffer(blob, np.uint64, len(blob) // 12))
            elif kind != "several":
                blobs[kind] = blob
        out = []
        if "pack" in blobs:
            ids, lengths, data = _unpacked(blobs["pack"])
            n = len(data)
            mask = np.unpackbits(_unpack(blobs["covered"], np.uint8), count=n).view(bool).copy()
            still = np.flatnonzero(np.unpackbits(_unpack(blobs["open"], np.uint8), count=n))
            if len(still):
                mask[still[_within(_fingerprints(Hashes(data), still, length), np.sort(np.concatenate(seen)))]] = True
            gone = _spread(mask, length)
            begin = 0
            for key, size in zip(ids.tolist(), lengths.tolist()):
                part = gone[begin : begin + size]
                removed = int(part.sum())
                spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()) if removed else 0
                kept = np.frombuffer(data, np.uint8, size, begin)[~part].tobytes() if removed else data[begin : begin + size]
                out.append((key, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                begin += size
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=names)

    rows = _by_shard(shards.unionByName(settled.where("kind != 'string'")).unionByName(answers), tasks)
    return rows.groupBy("shard").applyInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def by_induced_sorting(shard: Shard, starts: np.ndarray, memory: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings at ``starts`` an earlier text of the shard holds, and one start of each distinct string.

    The suffixes of the regions under the strings are sorted; neighbours with a common prefix of ``length`` are equal.
    """
    if not len(starts):
        return np.zeros(0, bool), starts
    n, length = len(shard.data), shard.length
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + length] -= 1
    place = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    doc = np.searchsorted(shard.ends, place, "right")
    cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(doc) > 0)) + 1
    t = np.concatenate([np.insert(shard.data[place].astype(np.int64) + 2, cut, 1), [0]])
    place = np.concatenate([np.insert(place, cut, -1), [-1]])
    order, lcp = suffix_array(t, length, memory)
    number = np.full(n + 1, -1, np.int64)
    number[starts] = np.arange(len(starts))
    number[-1] = -1
    which = number[place[order]]
    at = np.flatnonzero(which >= 0)
    which = which[at]
    new = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) < length
    new[0] = True
    head = np.flatnonzero(new)
    group = shard.group[np.searchsorted(shard.ends, starts[which], "right")]
    local = np.zeros(len(starts), bool)
    local[which] = group > np.repeat(np.minimum.reduceat(group, head), np.diff(np.append(head, len(which))))
    return local, starts[which[head]]


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, engine=by_induced_sorting) -> DataFrame:
    """Per document (id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of every text."""
    bounded_batches(documents.sparkSession)
    size = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first().n or 0
    n = max(1, -(-size // (SHARDS_A_FILE * shard_bytes)))
    parts = max(1, -(-size * 2 // (length - gram + 2) // RANGE_ROWS))
    shards = _packed_shards(documents, id_col, text_col, n, shard_bytes)
    release(documents.sparkSession)
    answers = _answers(_offers(shards, parts, length, gram), 4, parts)
    release(documents.sparkSession)
    settled = _settle(shards, answers, parts, n, length, gram, engine)
    release(documents.sparkSession)
    found = _answers(settled.where("kind = 'string'"), 0, parts)
    release(documents.sparkSession)
    out = _finish(shards, settled, found, n, id_col, length)
    no_id = documents.where(F.col(id_col).isNull()).select(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("kept"))
    loose = no_id.select(F.lit(None).cast("long").alias(id_col), F.length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    return out.unionByName(loose)
