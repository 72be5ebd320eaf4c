"""Packing of token sequences by vector bin packing with the dot-product heuristic.

A sequence is a bin with three limits: tokens, segments and loss-bearing tokens. The open bin takes, of all items that fit,
the one whose size vector has the largest dot product with what the bin has left, each in shares of its limit. Rows bear
loss on all of their tokens or on none, so within each of these two kinds the product grows with the tokens: the best
item of a kind is its longest that fits, found by bisection, and the two kinds' products are compared.

When no whole item fits, the bin's gap is filled with a piece cut off the longest item that the rule prefers, so a bin is
closed with a gap only where its segments are used up, where loss-bearing tokens alone are left, or where a task ends.
Such a bin is cut into sequences whose lengths are powers of two, which need no padding either.

Each task packs the rows of its input partition as they come, with at most WINDOW tokens waiting, and no row is shuffled:
a lost task packs the same rows in the same way again.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches

WINDOW = 1 << 20  # tokens of rows that wait for a bin; packing goes on until half of them are left
WORDS_KEPT = 1_000_000  # words that a worker remembers the ids of, about 200 bytes each
TEXTS, TEXT_BYTES = 200, 1 << 20  # texts whose words are looked up together
PIECES = 2000  # rows of an output batch
TASK_BITS = 33  # sequences of a task are numbered in so many bits, below its number
TRAILING = ".,;:!?"
#: Letters that the tokenizer lower-cases one by one, composes with nothing behind them, and has as letters.
LETTERS = "".join(c for c in map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0x17F))) if c.isalpha() and c not in "\u0130\u0149")
LETTERS_ONLY = re.compile(f"[{LETTERS}]+").fullmatch
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss boolean"


class WordIds:
    """Token ids of texts by a tokenizer that drops white space and never joins what it parts: words are encoded once.

    A worker keeps the ids of up to WORDS_KEPT words over its tasks; beyond that, those of the words it met first, which are
    the common ones. Case is dropped by the tokenizer, and a run of TRAILING behind a letter is a unit of its own to it,
    so both are taken off before a word is encoded. Words of letters alone are one unit, and go to the merges directly.
    """

    _of: dict = {}

    @classmethod
    def get(cls, path: str) -> WordIds:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        to_chars = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.chars = {ord(c): to_chars(c)[0][0] for c in LETTERS}  # a letter as the characters that stand for its bytes
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _learn(self, words: set[bytes]) -> None:
        merge, chars, pack = self.tokenizer.model.tokenize, self.chars, [struct.Struct(f"<{n}I").pack for n in range(64)]
        known, ends, others, cores = self.known, {}, [], {}
        for word in words:
            text = word.decode()
            core = text.rstrip(TRAILING)
            if not LETTERS_ONLY(core) or len(core) > 60:
                others.append(word)
                continue
            low = core.lower()
            if low not in cores:
                ids = [t.id for t in merge(low.translate(chars))]
                cores[low] = pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
            tail = text[len(core) :]
            if tail and tail not in ends:
                ends[tail] = self._encode([tail.encode()])[0]
            known[word] = cores[low] + ends[tail] if tail else cores[low]
        for at in range(0, len(others), 4096):
            known.update(zip(others[at : at + 4096], self._encode(others[at : at + 4096])))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each of ``texts`` in UTF-8, as little-endian unsigned 32-bit integers."""
        if len(self.known) > WORDS_KEPT:
            self.known = dict(islice(self.known.items(), WORDS_KEPT // 4))
        split = [text.split() for text in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words))


class Packer:
    """Packs items as they come; ``done`` holds finished pieces (key, start, length, ids, tokens, sequence, offset, loss)."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first: int = 0):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("limits are 1 at least")
        self.limits = (capacity, max_segments, max_loss)
        self.number, self.waiting, self.serial = first, 0, 0
        self.items: tuple[list, list] = ([], [])  # (tokens left, serial) without loss and with loss, ascending
        self.rows: dict[int, list] = {}  # by serial: key, ids, tokens, tokens before those left
        self.done: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.bin, self.left = [], list(self.limits)

    def add(self, key, ids: bytes, loss: bool) -> None:
        n, most = len(ids) // 4, min(self.limits[0], self.limits[2] if loss else self.limits[0])
        start = 0
        if most == self.limits[0]:  # whole sequences of one text
            while n - start >= most:
                self._emit([(key, start, most, ids[4 * start : 4 * (start + most)], n, loss)])
                start += most
        if start < n:
            self.serial += 1
            self.rows[self.serial] = [key, ids, n, start]
            insort(self.items[loss], (n - start, self.serial))
            self.waiting += n - start
        if self.waiting > WINDOW:
            self.pack(WINDOW // 2)

    def pack(self, least: int = 0) -> None:
        """Fill bins until ``least`` tokens or fewer wait; with 0, close the last one too."""
        while self.waiting > least:
            self._place()
        if not least:
            self._close()

    def _fits(self, loss: bool) -> int:
        """Tokens that a piece of this kind may have in the open bin."""
        return min(self.left[0], self.left[2]) if loss else self.left[0]

    def _product(self, tokens: int, loss: bool) -> float:
        c, s, m = self.limits
        return tokens / c * self.left[0] / c + self.left[1] / s / s + (tokens / m * self.left[2] / m if loss else 0.0)

    def _place(self) -> None:
        best = None
        for loss in (False, True):
            room, items = self._fits(loss), self.items[loss]
            if not items or room < 1:
                continue
            i = bisect_right(items, (room, float("inf"))) - 1
            if self.left[1] == 1 and items[-1][0] > room:
                i = -1  # the last segment is to fill the bin
            whole = i >= 0
            take = items[i][0] if whole else room
            first = take if self.left[1] == 1 else whole
            offer = (first, self._product(take, loss), take, loss, i if whole else len(items) - 1)
            best = offer if best is None or offer[:2] > best[:2] else best
        if best is None or not self.left[1]:
            self._close()
            return
        _, _, take, loss, i = best
        size, serial = self.items[loss].pop(i)
        row = self.rows[serial]
        key, ids, n, start = row
        self.bin.append((key, start, take, ids[4 * start : 4 * (start + take)], n, loss))
        if take == size:
            del self.rows[serial]
        else:
            row[3] += take
            insort(self.items[loss], (size - take, serial))
        self.waiting -= take
        self.left[0] -= take
        self.left[1] -= 1
        self.left[2] -= take * loss
        if not (self.left[0] and self.left[1]):
            self._close()

    def _close(self) -> None:
        """End the open bin; one that is not full becomes sequences of the powers of two that its length is the sum of."""
        pieces, used = self.bin, self.limits[0] - self.left[0]
        self._open()
        while pieces:
            room = self.limits[0] if used == self.limits[0] else 1 << used.bit_length() - 1
            used -= room
            part = []
            while room:
                key, start, length, ids, n, loss = pieces.pop(0)
                take = min(length, room)
                part.append((key, start, take, ids[: 4 * take], n, loss))
                if take < length:
                    pieces.insert(0, (key, start + take, length - take, ids[4 * take :], n, loss))
                room -= take
            self._emit(part)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, length, ids, n, loss in pieces:
            self.done.append((key, start, length, ids, n, self.number, offset, loss))
            offset += length
        self.number += 1


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, max_segments: int = 128, max_loss: int | None = None, end_id: int = 2, loss: str | None = None) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text), packed: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, loss).

    A row's tokens are those of its text and ``end_id``. ``loss`` names a boolean column, by which all tokens of a row bear
    loss or none does (as those of an assistant's turn, and of a user's); without it all do. A sequence holds up to
    ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens (by default all may be). ``ids`` are the
    piece's ids as little-endian unsigned 32-bit integers; pieces of a sequence follow each other from offset 0.

    A null or an empty text has ``end_id`` alone; a null ``loss`` is none. Equal and repeated rows and null ids are rows of
    their own, in pieces that can then not be told apart by doc_id. An empty table gives no row; further columns are not
    read. A row's ids are in memory while it waits; so is a very long text with them.
    """
    from pyspark import TaskContext

    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    limits = (capacity, max_segments, capacity if max_loss is None else max_loss)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds.get(vocabulary)
        packer = Packer(*limits, first=TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            for part in _parts(batch):
                keys, texts, bear = (part.column(i).to_pylist() for i in range(3))
                for key, ids, loss in zip(keys, encode([t or b"" for t in texts]), bear):
                    packer.add(key, ids + end, loss)
                    if len(packer.done) >= PIECES:
                        yield out(packer.done)
                        packer.done = []
        packer.pack()
        for at in range(0, len(packer.done), PIECES):
            yield out(packer.done[at : at + PIECES])

    bears = F.coalesce(F.col(loss), F.lit(False)) if loss else F.lit(True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), bears.alias("loss"))
    return rows.mapInArrow(run, SCHEMA)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of up to TEXTS rows whose texts hold TEXT_BYTES together, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= TEXTS or held + size > TEXT_BYTES):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
