"""Induced sorting against brute force, with queues in memory and on disk."""

import numpy as np
import pytest

from annalist.llm import suffix_dedup
from annalist.llm.induced_sort import RunQueue, suffix_array


def strings(rng):
    """Random strings over few characters, with periods and long runs."""
    x = rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(0, 120)))
    shape = rng.integers(4)
    if shape == 0 and len(x):
        x = np.tile(x[: int(rng.integers(1, 5))], 40)
    if shape == 1:
        x = np.repeat(x, rng.integers(1, 9, len(x)))
    return np.append(x, 0)


@pytest.mark.parametrize("memory, batch", [(50, 3), (1000, 20), (1 << 26, 1 << 16)])
def test_order_and_prefixes(memory, batch):
    rng = np.random.default_rng(3)
    for _ in range(150):
        t, depth = strings(rng), int(rng.integers(1, 30))
        order, lcp = suffix_array(t, depth, memory, batch)
        assert sorted(order.tolist()) == list(range(len(t)))
        heads = [tuple(t[i : i + depth].tolist()) for i in order]
        assert heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], lcp[1:].tolist()):
            assert a[:n] == b[:n] and (n == depth or a[n : n + 1] != b[n : n + 1])


def test_one_long_run():
    t = np.append(np.full(300_000, 7), 0)
    order, lcp = suffix_array(t, 50)
    assert len(np.unique(order)) == len(t) and order[:3].tolist() == [300_000, 299_999, 299_998]
    assert lcp[:60].tolist() == [0, *range(50), *[50] * 9]


def test_queue_spills_and_keeps_arrivals_in_order():
    rng, q, want = np.random.default_rng(1), RunQueue(2000), []
    for step in range(40):
        key = rng.integers(step, step + 30, 25)
        pos = np.arange(25) + 25 * step
        q.push(key, pos)
        want += list(zip(key.tolist(), pos.tolist()))
        got = list(zip(*(x.tolist() for x in q.pop(step + 1)[:2])))
        assert got == sorted(w for w in want if w[0] < step + 1)
        want = [w for w in want if w[0] >= step + 1]
    assert q.spilt > 0
    assert list(zip(*(x.tolist() for x in q.pop(1000)[:2]))) == sorted(want)


def test_repeats_within_a_shard():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcd"), 30)) for _ in range(30)]
    texts = [" ".join(rng.choice(words, 12)).encode() for _ in range(40)] + [b"", b"short", b"a" * 500, b"a" * 300]
    ids = np.arange(len(texts)) // 2  # pairs of texts share an id
    shard = suffix_dedup.Shard(ids, np.array([len(t) for t in texts]), b"".join(texts))
    for which in (np.arange(len(shard.start)), np.arange(0, len(shard.start), 3), np.zeros(0, np.int64)):
        starts = shard.strings(which)
        local, first = suffix_dedup.by_induced_sorting(shard, starts, 4000)
        data = shard.data.tobytes()
        held = [(data[i : i + 50], int(ids[np.searchsorted(shard.ends, i, "right")])) for i in starts.tolist()]
        least = {}
        for string, key in held:
            least[string] = min(key, least.get(string, key))
        assert local.tolist() == [least[string] < key for string, key in held]
        assert sorted(data[i : i + 50] for i in first.tolist()) == sorted(least)
