"""Benchmark decontamination: a BM25 inverted index of test items, queried with block-max WAND by every passage.

Items are cut into segments of at most SEGMENT words; each term's postings list segments with their BM25 impact, in
blocks of BLOCK segments with the largest impact of each block. Texts are cut into passages of 2 x SEGMENT words that
overlap by half, so every run of SEGMENT words lies whole in a passage. A passage retrieves every segment whose score
reaches THRESHOLD of the score that the segment gives itself. The block maxima of all passages of a text are summed
first, vectorised, and only passages for which some block can reach a threshold are scored by WAND. What is
retrieved is verified: the share of the item's five-word shingles that occur anywhere in the text (OVERLAP or more), and
that of its question (all but the last sentence) and of its answer (the last sentence) on their own; parts of fewer than
SHORT words are compared by pairs of words, for one changed word would spoil most of their shingles, and those of fewer
than five not on their own.

Term frequencies, the number of segments and their mean length are counted once over all items, so an item's scores and
thresholds do not depend on how items are dealt. The index of up to SLICE items or SLICE_BYTES of their text (or of one longer
item) is a slice; slices are broadcast together up to GROUP_BYTES and queried in one pass over the texts, and more slices
make more passes. An index is linear in its items' words: postings and block maxima are kept for the blocks alone that
hold a term, and as a table while that is small. Every
text is read whole; block maxima are summed for STRETCH halves of a passage at a time, so that memory does not grow with
the length of a text beyond its words.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is one shingle; equal
items are all reported; an empty benchmark or table gives no matches; repeated rows give repeated results; other columns,
whatever their names, are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, mix64, written

SEGMENT = 64
BLOCK = 4
K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP, PART_OVERLAP = 0.8, 0.5
SHINGLE = 5
SHORT = 15  # words of a question or answer under which it is compared by pairs of words
NEAR_PAIRS, NEAR_WORDS = 0.75, 0.85
SLICE = 1000
SLICE_BYTES = 1 << 20  # of the texts of a slice
TABLE_BYTES = 16 << 20  # up to which all terms have a row of all block maxima
COMMON = 16  # beyond it, a term in one block of so many has one
GROUP_BYTES = 128 << 20  # of the indexes that are broadcast together
STRETCH = 4096

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, given the words' hashes."""
    if k < 1 or len(ids) < k:
        return np.zeros(0, np.uint64)
    h = ids[: len(ids) - k + 1].copy()
    for i in range(1, k):
        h = h * _GOLD + ids[i : len(ids) - k + 1 + i]
    return np.unique(mix64(h))


def segments_of(words: list[str]) -> list[list[str]]:
    """Segments of an item, of even length, so that no short rest matches everything."""
    parts = -(-len(words) // SEGMENT)
    return [words[k * len(words) // parts : (k + 1) * len(words) // parts] for k in range(parts)]


def counts_of(texts) -> tuple[Counter, int, int]:
    """Of the segments of items: how many hold each term, how many there are, and their words."""
    frequency, size, total = Counter(), 0, 0
    for text in texts:
        for segment in segments_of(words_of(text)) if text else ():
            frequency.update(set(segment))
            size += 1
            total += len(segment)
    return frequency, size, total


class Index:
    """Impact-ordered facts of a BM25 index with block maxima, and the items for verification.

    ``counts`` are those of the whole benchmark (``counts_of``); without them, the items are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], counts: tuple | None = None):
        self.items = [(i, words_of(t)) for i, t in items if t and words_of(t)]
        self.parts = {}
        segments, of = [], []
        for n, (_, words) in enumerate(self.items):
            own = segments_of(words)
            segments += own
            of += [n] * len(own)
        self.of, self.size = np.array(of, np.int64), len(segments)
        self.terms: dict[str, int] = {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        frequency, everything, total = counts or counts_of(t for _, t in items)
        average = total / max(1, everything)
        self.own = np.zeros(self.size)
        for n, s in enumerate(segments):
            for t, tf in Counter(s).items():
                idf = math.log1p((everything - frequency[t] + 0.5) / (frequency[t] + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / average))
                postings[self.terms.setdefault(t, len(self.terms))].append((n, impact))
                self.own[n] += impact
        self.need = THRESHOLD * self.own
        self.postings = [(np.array([p[0] for p in postings[t]]), np.array([p[1] for p in postings[t]])) for t in range(len(self.terms))]
        self.blocks = blocks = -(-self.size // BLOCK)
        of, tops = [], []  # for each term, the blocks that hold it, and its largest impact in each
        for at, impact in self.postings:
            own, first = np.unique(at // BLOCK, return_index=True)
            of.append(own)
            tops.append(np.maximum.reduceat(impact, first))
        self.block_starts = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
        self.block_of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.block_top = np.concatenate(tops) if tops else np.zeros(0)
        self.term_max = np.array([x.max() for x in tops])
        wide = np.diff(self.block_starts)
        self.dense = len(wide) * blocks * 4 <= TABLE_BYTES
        common = np.arange(len(wide)) if self.dense else np.flatnonzero(wide * COMMON >= blocks)  # a table that is linear in the postings too
        self.row_of, self.rows = np.full(len(wide), -1, np.int64), np.zeros((0, blocks), np.float32)
        table = np.zeros((len(common), blocks), np.float32)
        table.ravel()[self._places(np.arange(len(common)), common)] = self.block_top[self._entries(common)]
        self.row_of[common], self.rows = np.arange(len(common)), table
        self.block_need = np.array([self.need[b * BLOCK : (b + 1) * BLOCK].min() for b in range(blocks)])
        self.least = float(self.need.min()) if self.size else math.inf

    def size_in_bytes(self) -> int:
        return self.rows.nbytes + sum(200 + 32 * len(p[0]) for p in self.postings) + sum(60 * len(w) for _, w in self.items)

    def tops_of(self, terms: np.ndarray) -> np.ndarray:
        """Block maxima of a few terms, a row for each."""
        if self.dense:
            return self.rows[terms]
        out = np.zeros((len(terms), self.blocks), np.float32)
        common = self.row_of[terms]
        out[common >= 0] = self.rows[common[common >= 0]]
        at = np.flatnonzero(common < 0)
        out.ravel()[self._places(at, terms[at])] = self.block_top[self._entries(terms[at])]
        return out

    def _entries(self, terms: np.ndarray) -> np.ndarray:
        """The places of the block maxima of ``terms``, those of each one after another."""
        wide = self.block_starts[terms + 1] - self.block_starts[terms]
        ends = np.cumsum(wide)
        return np.arange(wide.sum()) + np.repeat(self.block_starts[terms] - ends + wide, wide)

    def _places(self, row: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Where they stand in a table of all blocks, each in its ``row``."""
        return np.repeat(row, self.block_starts[terms + 1] - self.block_starts[terms]) * self.blocks + self.block_of[self._entries(terms)]

    def sums_of(self, row: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
        """The block maxima of ``terms``, each added to its ``row`` of a table of ``rows``; rows are ascending."""
        if rows == 1 and self.dense:
            return self.rows[terms].sum(0, keepdims=True)
        out = np.zeros((rows, self.blocks), np.float32)
        common = self.row_of[terms]
        at = np.flatnonzero(common >= 0)
        if len(at):
            first = np.flatnonzero(np.diff(row[at], prepend=-1))
            out[row[at[first]]] = np.add.reduceat(self.rows[common[at]], first, axis=0)
        at = np.flatnonzero(common < 0)
        if len(at):
            out += np.bincount(self._places(row[at], terms[at]), self.block_top[self._entries(terms[at])], rows * self.blocks).reshape(rows, self.blocks)
        return out

    def search(self, terms: list[int], live: list[int] | None = None) -> list[tuple[int, float]]:
        """All segments that reach their thresholds for a passage's distinct terms: block-max WAND.

        ``live`` lists the blocks whose maxima reach a threshold of theirs, if that is known; all others are skipped.
        """
        live = list(range(self.blocks)) if live is None else live
        if not live:
            return []
        lists = [(*(x.tolist() for x in self.postings[t]), float(self.term_max[t]), tops) for t, tops in zip(terms, self.tops_of(np.array(terms, np.int64)))]
        at = [bisect_left(x[0], live[0] * BLOCK) for x in lists]
        order = list(range(len(lists)))
        found, last, alive = [], self.size, 0
        while True:
            order = [i for i in order if at[i] < len(lists[i][0])]
            order.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, -1
            for n, i in enumerate(order):
                bound += lists[i][2]
                if bound >= self.least - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                return found
            segment = lists[order[pivot]][0][at[order[pivot]]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]][0][at[order[pivot + 1]]] == segment:
                pivot += 1
            block = segment // BLOCK
            alive = bisect_left(live, block, alive)
            if alive == len(live):
                return found
            if live[alive] > block:
                for i in order:
                    at[i] = bisect_left(lists[i][0], live[alive] * BLOCK, at[i])
                continue
            if sum(float(lists[i][3][block]) for i in order[: pivot + 1]) >= float(self.block_need[block]) - 1e-4:
                if lists[order[0]][0][at[order[0]]] == segment:
                    score = 0.0
                    for i in order[: pivot + 1]:
                        score += lists[i][1][at[i]]
                        at[i] += 1
                    if score >= self.need[segment] - 1e-9:
                        found.append((segment, score))
                    continue
                to = segment
            else:  # no segment of this block can be reached by these lists
                after = lists[order[pivot + 1]][0][at[order[pivot + 1]]] if pivot + 1 < len(order) else last
                to = max(segment + 1, min((block + 1) * BLOCK, after))
            for i in order[: pivot + 1]:
                at[i] = bisect_left(lists[i][0], to, at[i])


class Matcher:
    """Matches of texts with the items of an index."""

    def __init__(self, index: Index, overlap: float = OVERLAP):
        self.index, self.overlap, self.memo = index, overlap, {}
        self.targets = [self._target(words) for _, words in index.items]

    def _ids(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 100_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode())
        return mix64(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))

    def _target(self, words: list[str]):
        return min(SHINGLE, len(words)), self._ids(words)

    def candidates(self, words: list[str]) -> dict[int, tuple[float, list[int]]]:
        """Best score of each item retrieved by some passage of the text, and the halves that these passages begin with."""
        index = self.index
        ids = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        halves = -(-len(words) // SEGMENT)
        n_terms = len(index.terms)
        pairs = np.unique(at // SEGMENT * n_terms + ids[at])  # the terms of each half, once
        half, term = pairs // n_terms, pairs % n_terms
        starts = np.searchsorted(half, np.arange(halves + 1))
        best: dict[int, tuple[float, list[int]]] = {}
        for lo in range(0, halves, STRETCH):
            hi = min(lo + STRETCH, halves)
            inner = starts[lo : min(hi + 1, halves) + 1]  # with the half after the stretch
            if inner[0] == inner[-1]:
                continue
            sums = index.sums_of(half[inner[0] : inner[-1]] - lo, term[inner[0] : inner[-1]], hi - lo + 1)
            bound = sums[:-1] + sums[1:]  # of the passage of two halves; the last passage has one
            for p in (np.flatnonzero((bound >= index.block_need - 1e-3).any(1)) + lo).tolist():
                terms = np.unique(term[starts[p] : starts[min(p + 2, halves)]])
                both = index.sums_of(np.zeros(len(terms), np.int64), terms, 1)[0]  # terms of both halves count once
                live = np.flatnonzero(both >= index.block_need - 1e-3)
                if not len(live):
                    continue
                for segment, score in index.search(terms.tolist(), live.tolist()):
                    n = int(index.of[segment])
                    most, places = best.get(n, (0.0, []))
                    best[n] = (max(most, score), places + [p] if places[-1:] != [p] else places)
        return best

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, float]]:
        """(item, score, overlap, of question, of answer) of the verified items, by item."""
        words = words_of(text) if text else []
        found, runs = [], {}
        ids = None
        for n, (score, places) in sorted(self.candidates(words).items()):
            item, item_words = self.index.items[n]
            k, target = self.targets[n]
            if ids is None:
                ids = self._ids(words)
            cut = self._answer_at(n)
            shares = []
            for part, size in (target, k), (target[:cut], 0), (target[cut:], 0):
                size = size or (k if len(part) >= SHORT else 2)
                if len(part) < SHINGLE and part is not target:  # too few words to tell
                    shares.append(1.0)
                    continue
                if size not in runs:
                    runs[size] = _shingles(ids, size)
                s = _shingles(part, size)
                shares.append(float(np.isin(s, runs[size]).mean()) if len(s) else 1.0)
            if shares[0] >= self.overlap and min(shares[1:]) >= PART_OVERLAP or self._near(ids, target, cut, places):
                found.append((item, score, *shares))
        return sorted(found)

    def _near(self, ids: np.ndarray, target: np.ndarray, cut: int, places: list[int]) -> bool:
        """Whether the passages at ``places`` hold an item of some length but for a few of its words."""
        if len(target) < SHORT:
            return False
        passages = [ids[p * SEGMENT : (p + 2) * SEGMENT] for p in places]
        share = lambda part, k: float(np.isin(_shingles(part, k), np.concatenate([_shingles(p, k) for p in passages])).mean())
        parts = [x for x in (target[:cut], target[cut:]) if len(x) >= SHINGLE]
        return share(target, 1) >= NEAR_WORDS and share(target, 2) >= NEAR_PAIRS and min(share(x, 2) for x in parts) >= PART_OVERLAP

    def _answer_at(self, n: int) -> int:
        """Words before the answer: the last sentence, or the last quarter of a single one."""
        words = self.index.items[n][1]
        return self.index.parts.get(n) or max(1, len(words) * 3 // 4)


def build(items: list[tuple[int, str]], counts: tuple | None = None) -> Index:
    index = Index(items, counts)
    kept = [t for _, t in items if t and words_of(t)]
    for n, text in enumerate(kept):
        sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
        if len(sentences) > 1:
            index.parts[n] = len(index.items[n][1]) - len(words_of(sentences[-1]))
    return index


def _counted(items: DataFrame) -> DataFrame:
    """(term, n, words): segments of all items that hold each term; under the term null, all segments and their words."""

    def run(batches):
        frequency, size, total = Counter(), 0, 0
        for batch in batches:
            found = counts_of(batch.column(0).to_pylist())
            frequency.update(found[0])
            size, total = size + found[1], total + found[2]
        names, n = [None, *frequency], [size, *frequency.values()]
        words = [total] + [0] * len(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=["term", "n", "words"])

    return items.select("t").mapInArrow(run, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SLICE, most: int = SLICE_BYTES):
    """Indexes of up to ``size`` items or ``most`` bytes of text each, one after another, with the statistics of the whole benchmark.

    Items are dealt by their hashes into parts of about that many bytes, which the driver reads one after another, so it
    holds a part and a slice, or a longer item.
    """
    spark = benchmark.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-whole.n // size), -(-whole.b // most))
    counted = written(_counted(items), "terms") if parts > 1 else _counted(items)
    total = counted.where("term is null").first()
    part, held, k = [], 0, 0
    for r in items.repartition(parts, "i", "t").sortWithinPartitions("i", "t").toLocalIterator():
        n = len(r.t.encode())
        if part and (len(part) == size or held + n > most):
            yield _indexed(spark, part, counted, total, parts > 1)
            part, held, k = [], 0, k + 1
        part.append((r.i, r.t))
        held += n
    if part or not k:
        yield _indexed(spark, part, counted, total, parts > 1)


def _indexed(spark, items: list[tuple[int, str]], counted: DataFrame, total, narrow: bool) -> Index:
    terms = counted.where("term is not null").select("term", "n")
    if narrow:
        own = spark.createDataFrame([(t,) for t in sorted({w for _, text in items for w in words_of(text)})], "term string")
        terms = terms.join(own, "term", "left_semi")
    frequency = {r.term: r.n for r in terms.collect()}  # no more than the terms of the slice
    return build(items, (frequency, total.n if total else 0, total.words if total else 0))


def groups(benchmark: DataFrame, size: int = SLICE, most: int = GROUP_BYTES):
    """Broadcasts of lists of slices, each of ``most`` bytes or a single slice."""
    context, group, held = benchmark.sparkSession.sparkContext, [], 0
    for index in slices(benchmark, size=size):
        if group and held + index.size_in_bytes() > most:
            yield context.broadcast(group)
            group, held = [], 0
        group.append(index)
        held += index.size_in_bytes()
    yield context.broadcast(group)


def matches(
    documents: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE, most: int = GROUP_BYTES
) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): a row for each document and item it holds."""
    names = [id_col, "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    types = [pa.int64(), pa.int64()] + [pa.float64()] * 4
    source, out = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), None
    for group in groups(benchmark, size, most):

        def run(batches, group=group):
            matchers = [Matcher(index, overlap) for index in group.value]
            for batch in batches:
                texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                rows = [(key, *m) for key, text in texts for matcher in matchers for m in matcher.matches(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names=names)

        part = source.mapInArrow(run, f"{id_col} long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, text_col: str = "text", size: int = SLICE, most: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no item of the benchmark; between two groups of slices they are written."""
    at, first = documents.columns.index(text_col), True
    for group in groups(benchmark, size, most):

        def run(batches, group=group):
            matchers = [Matcher(index, overlap) for index in group.value]
            for batch in batches:
                yield batch.filter(pa.array([not any(m.matches(t) for m in matchers) for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = (documents if first else written(documents, "cleaned")).mapInArrow(run, documents.schema)
        first = False
    return documents
