"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pending merges wait in buckets, one per merge rank, that hold positions of a linked list of symbols. A bitmap
marks the non-empty buckets and each higher level marks the non-zero words of the level below, so the lowest
rank is found by one find-first-set per level, whatever the number of pending merges. Entries are never
removed from the middle: an entry whose pair has changed since is stale and skipped when it comes up. A
pre-token of n bytes costs O(n log n) and a few hundred bytes of state per byte, so very long pre-tokens
are safe.

Defined results: a null text counts as empty (no tokens); an empty table gives an empty result; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame

from annalist.llm.common import map_rows

CACHE_ENTRIES = 500_000  # distinct pre-tokens a task remembers; older ones are dropped together


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class RankQueue:
    """Priority queue over small integer ranks; equal ranks come out by position.

    Two levels of 256-bit words cover 65,536 ranks; larger vocabularies widen the top word.
    """

    BITS = tuple(1 << i for i in range(256))

    def __init__(self, size: int):
        self.words = [0] * (-(-size // 256) or 1)
        self.top = 0  # which words are not zero
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank >> 8
        self.words[at] |= self.BITS[rank & 255]
        self.top |= 1 << at

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        first = word & -word
        rank = (at << 8) + first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.words[at] = word = word ^ first
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Tokenizer:
    """Encoder and decoder for one vocabulary. ``encode`` memoises the packed ids of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.token = {rank: token for token, rank in ranks.items()}
        self.packed: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, push, pop = len(piece), ranks.get, self.queue.push, self.queue.pop
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pending = [-1] * (n + 1)  # rank of the pair that starts here
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pending[i] = rank
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if pending[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            pending[j] = pending[i] = -1
            if k < n:
                rank = get(piece[i : after[k]])
                if rank is not None:
                    pending[i] = rank
                    push(rank, i)
            if i:
                h = before[i]
                rank = get(piece[h:k])
                if rank is None:
                    pending[h] = -1
                elif pending[h] != rank:
                    pending[h] = rank
                    push(rank, h)
        ids, i = [], 0
        while i < n:
            k = after[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        packed, parts = self.packed, []
        for piece in self.split(text):
            got = packed.get(piece)
            if got is None:
                ids = self.merge(piece.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) < 64:
                    if len(packed) >= CACHE_ENTRIES:
                        packed.clear()
                    packed[piece] = got
            parts.append(got)
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _tokenizer_source(spark, vocabulary: str, pattern: str | None):
    """The vocabulary file is read on the driver and broadcast: under 1 MB for 50k ranks, checked."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("vocabulary file over 64 MB")
    return spark.sparkContext.broadcast(data), pattern


#: The last tokenizer of this worker process, so that its memo serves all tasks that the process runs.
_worker: dict[tuple[bytes, str], Tokenizer] = {}


def _worker_tokenizer(data: bytes, pattern: str) -> Tokenizer:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Tokenizer(load_ranks(data), pattern)
    return _worker[key]


def encode(df: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (id, ids array<int>). Reads the id and text columns only."""
    data, pattern = _tokenizer_source(df.sparkSession, vocabulary, pattern)

    def make():
        tokenizer = _worker_tokenizer(data.value, pattern)
        return lambda key, text: (key, tokenizer.encode(text or ""))

    return map_rows(df, [id_col, text_col], f"{id_col} long,ids array<int>", make)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every list of ids: (id, decoded binary); a null list decodes to no bytes."""
    data, _ = _tokenizer_source(df.sparkSession, vocabulary, "")

    def make():
        token = {rank: token for token, rank in load_ranks(data.value).items()}
        return lambda key, ids: (key, b"".join(map(token.__getitem__, ids or [])))

    return map_rows(df, [id_col, ids_col], f"{id_col} long,decoded binary", make)


def encode_digests(df: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: token count and digests of the ids and of the decoded bytes."""
    data, pattern = _tokenizer_source(df.sparkSession, vocabulary, pattern)

    def make():
        tokenizer = _worker_tokenizer(data.value, pattern)

        def one(key, text):
            packed = tokenizer.encode_packed(text or "")
            decoded = tokenizer.decode(np.frombuffer(packed, "<u4").tolist())
            return key, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return one

    return map_rows(df, [id_col, text_col], f"{id_col} long,n_tokens long,ids_sha256 string,decoded_sha256 string", make)


