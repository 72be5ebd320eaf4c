"""External induced sorting of suffixes, in bulk: every queue operation moves arrays of tuples, never one.

A suffix that is larger than its successor ("descending") is ordered by its first character and its successor's rank, so
the sorted successors push tuples (character, position, common prefix) into a priority queue, which gives them back a
range of characters at a time. The "ascending" suffixes mirror that over the complemented alphabet. Both start from the
leftmost ascending suffixes (LMS), whose order comes from naming the substrings between them and sorting the string of
names in the same way, recursively. Queues keep their runs on disk beyond a bound.

Suffixes are ordered by their first ``depth`` characters only, ties in any order. A name covers two characters or more,
so the depth halves with each level, and the recursion ends after log2(depth) levels at the latest. Common prefixes are
measured for the LMS suffixes, and induced from there: those of two neighbours in a bucket are one more than the minimum
between their successors, which is carried per character from batch to batch.

In memory: the text of the level with its types (12 bytes a character), and the tuples of one batch.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

QUEUE_BYTES = 64 << 20
BATCH = 1 << 16


class RunQueue:
    """A priority queue of (key, position, prefix) tuples: sorted runs, on disk once ``memory`` bytes are held.

    Runs come in the order of their ranks, so equal keys leave in the order of arrival. Spilt runs are unlinked files in
    Spark's scratch folder: they belong to one attempt of a task and end with it.
    """

    _ROW = np.dtype([("key", "<i8"), ("pos", "<i8"), ("lcp", "u1")])
    _FEW = 1024  # keys under this have their places in a run listed

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.held, self.spilt = memory, 0, 0
        self.disk: list[list] = []
        self.runs: list[list] = []

    def push(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None = None) -> None:
        if not len(key):
            return
        order = _stable(key)
        self._add(key[order], pos[order], np.zeros(len(key), np.uint8) if lcp is None else lcp[order])

    def _add(self, key, pos, lcp) -> None:
        cuts = [0, *np.cumsum(np.bincount(key)).tolist()] if key[-1] < self._FEW else None
        self.runs.append([key, pos, lcp, 0, cuts])
        self.held += len(key) * self._ROW.itemsize
        if self.held > self.memory:
            rest = [(k[at:], p[at:], c[at:]) for k, p, c, at, _ in self.runs]
            key, pos, lcp = (np.concatenate(x) for x in zip(*rest))
            order = _stable(key)
            rows = np.empty(len(key), self._ROW)
            rows["key"], rows["pos"], rows["lcp"] = key[order], pos[order], lcp[order]
            self.runs, self.held = [], 0
            if len(rows):
                with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
                    rows.tofile(f)
                    f.flush()
                    mapped = np.memmap(f, self._ROW, "r", shape=(len(rows),))
                self.disk.append([mapped, 0])
                self.spilt += 1

    def pop(self, below: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples with a key under ``below``: sorted, or in order of arrival within each key."""
        parts = []
        for run in self.disk:
            rows, at = run
            end = at + int(np.searchsorted(rows["key"][at:], below))
            if end > at:
                parts.append((rows["key"][at:end], rows["pos"][at:end], rows["lcp"][at:end]))
                run[1] = end
        for run in self.runs:
            key, pos, lcp, at, cuts = run
            end = cuts[min(below, len(cuts) - 1)] if cuts else int(np.searchsorted(key, below))
            if end > at:
                parts.append((key[at:end], pos[at:end], lcp[at:end]))
                run[3] = end
                self.held -= (end - at) * self._ROW.itemsize
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.disk = [r for r in self.disk if r[1] < len(r[0])]
        self.runs = [r for r in self.runs if r[3] < len(r[0])]
        key, pos, lcp = (np.concatenate(x) for x in zip(*parts))
        if not ordered or min(k[0] for k, _, _ in parts) == max(k[-1] for k, _, _ in parts):
            return key, pos, lcp
        order = _stable(key)
        return key[order], pos[order], lcp[order]


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers that are not negative; narrow ones are sorted with their places in the low bits."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits <= 63:
        x = key << bits | np.arange(len(key))
        x.sort()
        return x & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def ascending(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last, a character smaller than all others, counts as such."""
    n = len(t)
    up = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        up[:-1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    return up


def _leftmost(up: np.ndarray) -> np.ndarray:
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1


def _induced(t: np.ndarray, member: np.ndarray, bases: np.ndarray, depth: int, memory: int, batch: int) -> np.ndarray:
    """The suffixes in ``member`` (characters not rising, up to a base) in order, from the ordered ``bases``.

    A batch takes a range of characters. Suffixes whose successors are in the same batch are ordered with them, by all
    the characters down to a suffix that was known before it.
    """
    queue, out = RunQueue(memory), []
    base_t = t[bases]
    load = np.cumsum(np.bincount(t[member], minlength=int(t.max()) + 1) + np.bincount(base_t, minlength=int(t.max()) + 1))
    low, done = 0, 0
    while low < len(load):
        high = max(low + 1, int(np.searchsorted(load, done + batch, "right")))
        done = int(load[high - 1])
        key, pos, _ = queue.pop(high, ordered=False)
        mine = bases[slice(*np.searchsorted(base_t, [low, high]))]
        origin = np.concatenate([pos, mine])
        if not len(origin):
            low = high
            continue
        rank = np.concatenate([2 * key, 2 * t[mine] + 1])
        order = _stable(rank)
        origin, rank = origin[order], rank[order]
        where, who, far = [origin], [np.arange(len(origin))], [np.zeros(len(origin), np.int64)]
        while len(where[-1]):
            before = where[-1] - 1
            ok = (before >= 0) & member[before] & (t[before] < high)
            where.append(before[ok])
            who.append(who[-1][ok])
            far.append(far[-1][ok] + 1)
        p, w, d = (np.concatenate(x) for x in (where, who, far))
        begin = np.cumsum([0] + [len(x) for x in where])  # the tuples of a distance of k or more begin at begin[k]
        bits = (2 * (high - low) + 2).bit_length()
        packed, columns = 62 // bits, []
        for k in range(min(len(where) - 2, depth) + 1):
            if k % packed == 0:
                columns.append(np.zeros(len(p), np.int64))
            at, mid = begin[k], begin[k + 1]
            shift = bits * (packed - 1 - k % packed)
            columns[-1][at:mid] |= (rank[w[at:mid]] - 2 * low + 2) << shift
            columns[-1][mid:] |= (2 * (t[p[mid:] + k] - low) + 2) << shift
        order = _stable(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
        p, inner = p[order], ((d > 0) | (rank[w] % 2 == 0))[order]
        out.append(p[inner])
        before = p[p > 0] - 1
        before = before[member[before] & (t[before] >= high)]
        queue.push(t[before], before)
        low = high
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _both(t: np.ndarray, up: np.ndarray, bases: np.ndarray, depth: int, memory: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Descending suffixes in order, and ascending suffixes (but the last) in falling order."""
    down = _induced(t, ~up, bases, depth, memory, batch)
    turns = down[::-1]
    turns = turns[(turns > 0) & up[turns - 1]]
    rest = up.copy()
    rest[-1] = False
    return down, _induced(t.max() - t, rest, turns, depth, memory, batch)


def _different(t: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of substrings differ within ``depth`` characters."""
    out = np.minimum(size_a, depth) != np.minimum(size_b, depth)
    live = np.flatnonzero(~out)
    for k in range(depth):
        live = live[size_a[live] > k]
        if not len(live):
            break
        unequal = t[a[live] + k] != t[b[live] + k]
        out[live[unequal]] = True
        live = live[~unequal]
    return out


def sorted_lms(t: np.ndarray, up: np.ndarray, depth: int, memory: int, batch: int) -> np.ndarray:
    """LMS suffixes in the order of their first ``depth`` characters."""
    lms = _leftmost(up)
    _, falling = _both(t, up, lms[_stable(t[lms])], depth, memory, batch)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    inner = falling[::-1]
    inner = np.concatenate([lms[-1:], inner[is_lms[inner]]])
    number = np.searchsorted(lms, inner)
    size = np.diff(np.concatenate([lms, lms[-1:]]))[number] + 1
    new = _different(t, inner[1:], inner[:-1], size[1:], size[:-1], depth)
    names = np.zeros(len(lms), np.int64)
    names[number] = np.concatenate([[0], np.cumsum(new)])
    if new.all() or depth <= 2:
        return lms[np.argsort(names, kind="stable")]
    return lms[_order(names, -(-depth // 2), memory, batch)]


def _order(t: np.ndarray, depth: int, memory: int, batch: int) -> np.ndarray:
    """All suffixes of a string of names."""
    up = ascending(t)
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    down, falling = _both(t, up, sorted_lms(t, up, depth, memory, batch), depth, memory, batch)
    every = np.concatenate([[len(t) - 1], down, falling[::-1]])
    return every[np.argsort(2 * t[every] + up[every], kind="stable")]


def _words(t: np.ndarray) -> np.ndarray:
    """Four characters from every position, the first in the lowest bits."""
    padded = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    out = padded[: len(t)].copy()
    for k in range(1, 4):
        out |= padded[k : k + len(t)] << np.uint64(16 * k)
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, ``depth`` at most."""
    out = np.full(len(a), depth, np.int64)
    live = np.arange(len(a))
    for k in range(0, depth, 4):
        live = live[(a[live] + k < len(words)) & (b[live] + k < len(words))]
        x = words[a[live] + k] ^ words[b[live] + k]
        found = np.flatnonzero(x)
        low = x[found] & (~x[found] + np.uint64(1))
        out[live[found]] = np.minimum(depth, k + np.bitwise_count(low - np.uint64(1)) // 16)
        live = live[x == 0]
        if not len(live):
            break
    return out.astype(np.uint8)


class _Minimum:
    """Minima of ranges [i, j] of an array."""

    def __init__(self, a: np.ndarray):
        self.rows = [a]
        while 2 << (len(self.rows) - 1) <= len(a):
            half, r = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(r[:-half], r[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.uint8)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][i[at]], self.rows[k][j[at] - (1 << k) + 1])
        return out


def _induced_with_prefixes(t, member, bases, base_lcp, words, depth, memory) -> tuple[np.ndarray, np.ndarray]:
    """As ``_induced``, one character a batch; also each suffix's common prefix with the one before it in its bucket."""
    queue, out_p, out_l = RunQueue(memory), [], []
    n_chars = int(t.max()) + 1
    since = np.zeros(n_chars, np.uint8)  # least common prefix since the last tuple was pushed for a character
    base_t = t[bases]
    cuts = np.searchsorted(base_t, np.arange(n_chars + 1))
    run = np.arange(len(t)) - np.maximum.accumulate(np.where(np.r_[True, t[1:] != t[:-1]], np.arange(len(t)), 0))  # equal characters before
    for c in range(n_chars):
        _, pos, lcp = queue.pop(c + 1)
        ps, ls = [], []
        turn = 0
        while len(pos):
            lcp = lcp.copy()
            ps.append(pos)
            ls.append(np.concatenate([[min(turn, depth)], lcp[1:]]).astype(np.uint8))
            turn += 1
            longer = np.flatnonzero(run[pos] > 0)
            if not len(longer):
                break
            if turn > depth:  # what is left shares all of depth
                many = run[pos[longer]]
                ps.append(np.repeat(pos[longer] - 1 + np.cumsum(many) - many, many) - np.arange(many.sum()))
                ls.append(np.full(many.sum(), depth, np.uint8))
                break
            begin = np.concatenate([[0], longer[:-1] + 1])
            lcp = np.minimum(np.minimum.reduceat(lcp[: longer[-1] + 1], begin) + np.uint8(1), depth).astype(np.uint8)
            pos = pos[longer] - 1
        mine = slice(cuts[c], cuts[c + 1])
        p = np.concatenate([*ps, bases[mine]]).astype(np.int64)
        if not len(p):
            continue
        inner = len(p) - (cuts[c + 1] - cuts[c])
        seq = np.concatenate([*ls, base_lcp[mine]]).astype(np.uint8)
        seq[0] = 0
        if 0 < inner < len(p):
            seq[inner] = _common(words, p[inner - 1 : inner], p[inner : inner + 1], depth)[0]
        out_p.append(p[:inner])
        out_l.append(seq[:inner])
        k = np.flatnonzero(p > 0)
        k = k[member[p[k] - 1] & (t[p[k] - 1] > c)]
        char = t[p[k] - 1]
        order = _stable(char)
        k, char = k[order], char[order]
        least = _Minimum(seq)
        if len(k):
            first = np.r_[True, char[1:] != char[:-1]]
            begin = np.where(first, 0, np.r_[0, k[:-1]] + 1)
            low = least(begin, k)
            low[first] = np.minimum(low[first], since[char[first]])
            queue.push(char, p[k] - 1, np.minimum(low + np.uint8(1), depth).astype(np.uint8))
        since = np.minimum(since, seq.min())
        if len(k):
            last = np.flatnonzero(np.r_[char[1:] != char[:-1], True])
            tail = np.minimum.accumulate(seq[::-1])[::-1]
            since[char[last]] = np.where(k[last] + 1 < len(seq), tail[np.minimum(k[last] + 1, len(seq) - 1)], depth)
    if not out_p:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(out_p), np.concatenate(out_l)


def suffix_array(t: np.ndarray, depth: int, memory: int = QUEUE_BYTES, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``t`` by their first ``depth`` (up to 254) characters, and each one's common prefix with the one before.

    ``t`` holds characters under 2**16 and ends with a character smaller than all others.
    """
    t = t.astype(np.int64)
    if len(t) < 3:
        order = np.argsort(t, kind="stable")
        return order, np.zeros(len(t), np.uint8)
    up, words = ascending(t), _words(t)
    seeds = sorted_lms(t, up, depth, memory, batch)
    seed_lcp = np.concatenate([[0], _common(words, seeds[1:], seeds[:-1], depth)]).astype(np.uint8)
    down, down_lcp = _induced_with_prefixes(t, ~up, seeds, seed_lcp, words, depth, memory)
    turn = np.flatnonzero(np.r_[False, up][down])  # descending, after an ascending one
    turn_lcp = np.minimum.reduceat(down_lcp[: turn[-1] + 1], np.concatenate([[0], turn[:-1] + 1])) if len(turn) else np.zeros(0, np.uint8)
    bases, base_lcp = down[turn][::-1], np.concatenate([[0], turn_lcp[:0:-1]]).astype(np.uint8)[: len(turn)]
    rest = up.copy()
    rest[-1] = False
    rise, rise_lcp = _induced_with_prefixes(t.max() - t, rest, bases, base_lcp, words, depth, memory)
    rise, rise_lcp = rise[::-1], np.concatenate([[0], rise_lcp[:0:-1]]).astype(np.uint8)[: len(rise)]
    every = np.concatenate([[len(t) - 1], down, rise])
    lcp = np.concatenate([[0], down_lcp, rise_lcp]).astype(np.uint8)
    kind = 2 * t[every] + up[every]
    order = _stable(kind)
    every, lcp, kind = every[order], lcp[order], kind[order]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    lcp[edge] = _common(words, every[edge], every[edge - 1], depth)
    return every, lcp
