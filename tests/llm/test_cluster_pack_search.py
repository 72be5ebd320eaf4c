"""Centroid clustering, packing and ranked search against brute force, with odd rows, ties, limits and lowered bounds."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import clustering, packing, queries, ranked_search
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
DOCS = "doc_id long, text string"
CLASHES = ("x", "cluster", "upper", "q", "id", "ids", "rank", "score", "loss", "length", "_g")


def clashing(df):
    """``df`` with columns that are named as the operators name their own."""
    return df.withColumns({c: F.lit(1) for c in CLASHES})


# --- op11 -----------------------------------------------------------------------------------------------------------


def naive_clusters(rows, k, rounds, dimension):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(min(math.floor(256 * x), clustering.LIMIT), -clustering.LIMIT) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for at in range(rounds + 1):
        own = [min((apart(v, c[j]), j) for j in range(len(c))) for _, v in kept]
        if at < rounds:
            for j in range(len(c)):
                if mine := [v for (_, v), (_, o) in zip(kept, own) if o == j]:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    by = defaultdict(int)
    for d, j in own if kept else ():
        by[j] += d
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return Counter((i, j, d, by[j], sum(by.values()), sha[j]) for (i, _), (d, j) in zip(kept, own)) if kept else Counter()


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    grid = [0.0, 1 / 256, 2 / 256, -1 / 256]  # few values: many ties of distances
    rows = [(i, [rng.choice(grid) for _ in range(4)]) for i in range(150)] + [(7, [0.0] * 4)] * 150
    rows += [(-1, None), (-2, [1.0] * 3), (-3, [1.0, None, 0.0, 0.0]), (-4, [math.nan] + [0.0] * 3), (-5, [math.inf] + [0.0] * 3), (None, [9.5] * 4), (-6, [1e30, -1e30, 0.0, 0.0])]
    vectors = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = Counter(tuple(r) for r in clustering.cluster(vectors, k=12, rounds=4, dimension=4).collect())
    assert got == naive_clusters(rows, 12, 4, 4)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 5):
        assert Counter(tuple(r) for r in clustering.cluster(vectors, k=k, dimension=2).collect()) == naive_clusters(rows, k, 5, 2)
    assert clustering.cluster(vectors.limit(0), dimension=2).count() == 0


def test_bounds_spare_distances():
    """After a round without movement no distance is computed, and scans of a ball are smaller than all centroids."""
    rng = np.random.default_rng(1)
    c = rng.integers(-5000, 5000, (64, 2))
    x = rng.integers(-5000, 5000, (500, 2))
    first = clustering.Centroids(c)
    cluster, upper, lower, _ = first.first(x)
    again, _, _, distance = clustering.Centroids(c, c).assign(x, cluster, upper, lower, False)
    assert (again == cluster).all() and (distance == -1).mean() > 0.9
    seen = []
    moved = clustering.Centroids(c + 1, c)
    scan = moved.scan
    moved.scan = lambda x, j: (seen.append(len(j)), scan(x, j))[1]
    got = moved.assign(x, cluster, upper * 3, lower * 0, True)[0]
    assert (got == clustering._squared(x, c + 1).argmin(axis=1)).all() and seen and np.mean(seen) < 32


# --- op12 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


ODD = [
    None, "", " \n\t ", "Hello, World! it's we're 'll '' ...;;", "ΣΑΣ ΟΔΟΣ. İstanbul naïve café, ﬁ", "a b c\x1cd\x85e", "<|endoftext|> <|ENDOFTEXT|>. x<|startoftext|>y.", "12,345.67 a.b.c. x1. ١٢٣. é. É;",
    "日本語。テスト! 🙂🙂 end.", "word " * 30_000, "\x00\x01 \x7f", "UPPER lower Title", "ǅ ß ẞ K K.",
]


def test_words_equal_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(3)
    letters = ["".join(rng.choices(packing.LETTERS, k=rng.randint(1, 12))) + rng.choice(["", ".", ",!"]) for _ in range(3000)]
    texts = [t or "" for t in ODD] * 2 + [" ".join(letters), " ".join(packing.LETTERS), "a" * 70 + " " + "é" * 59 + ","]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for kept in (packing.WORDS_KEPT, 3):
        monkeypatch.setattr(packing, "WORDS_KEPT", kept)
        ids = packing.WordIds(queries.word_vocabulary())
        for n in (1, len(texts)):
            got = [x for at in range(0, len(texts), n) for x in ids([t.encode() for t in texts[at : at + n]])]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def check_pieces(rows, tokens, capacity, segments=None, loss=None):
    """``rows`` (key, start, length, ids, n, sequence, offset, loss) hold each row of ``tokens`` once, in proper sequences without padding."""
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
        seq[r[5]].append(r)
    assert set(by) == set(tokens)
    for key, parts in by.items():
        parts.sort(key=lambda r: r[1])
        assert b"".join(p[3] for p in parts) == tokens[key] and all(p[4] == len(tokens[key]) // 4 and p[2] == len(p[3]) // 4 > 0 for p in parts)
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
    for parts in seq.values():
        parts.sort(key=lambda r: r[6])
        assert [p[6] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
        total = sum(p[2] for p in parts)
        assert total <= capacity and (total == capacity or total & (total - 1) == 0)
        assert segments is None or len(parts) <= segments
        assert loss is None or sum(p[2] for p in parts if p[7]) <= loss
    return len(seq)


@pytest.mark.parametrize("seed", range(4))
def test_packer_keeps_its_limits(monkeypatch, seed):
    monkeypatch.setattr(packing, "WINDOW", 500)
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, 17, 60, 64, 65, 300]) for _ in range(400)]
    tokens = {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(sizes)}
    for segments, loss in ((64, 64), (4, 40), (1, 1), (3, 64)):
        packer = packing.Packer(64, segments, loss)
        for i, ids in tokens.items():
            packer.add(i, ids, bool(i % 3))
        packer.pack()
        n = check_pieces(packer.done, tokens, 64, segments, loss)
        if (segments, loss) == (64, 64):
            assert n <= sum(sizes) // 64 + 7
    with pytest.raises(ValueError):
        packing.Packer(0, 1, 1)


def test_the_best_item_has_the_largest_dot_product():
    """What the open bin takes is what a scan of all items by their dot products takes."""
    rng = random.Random(5)
    packer = packing.Packer(100, 10, 50)
    for i in range(60):
        packer.add(i, bytes(4 * rng.randint(1, 70)), i % 2 == 0)
    for _ in range(40):
        items = [(t, loss) for loss in (False, True) for t, _ in packer.items[loss]]
        fit = [(packer._product(t, loss), t, loss) for t, loss in items if t <= packer._fits(loss)]
        before, left = len(packer.bin), list(packer.left)
        number = packer.number
        packer._place()
        if fit and left[1] > 1 and packer.number == number and len(packer.bin) > before:
            _, _, take, _, _, loss = packer.bin[-1]
            assert (take, loss) in {(t, x) for p, t, x in fit if p == max(fit)[0]}


def test_packed_documents_equal_the_tokenizer(spark, tokenizer):
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], DOCS)
    docs = clashing(odd.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).repartition(3))
    rows = [tuple(r) for r in packing.pack(docs, queries.word_vocabulary()).collect()]
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in texts.items()}
    check_pieces(rows, want, 4096, 128)
    got = packing.digests(packing.pack(docs, queries.word_vocabulary())).collect()
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) for r in got) and len(got) == len(rows)
    assert packing.pack(docs.limit(0), queries.word_vocabulary()).count() == 0


def test_turns_by_role(spark):
    """Only turns of an assistant bear loss; the limit of loss-bearing tokens holds in every sequence."""
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").withColumns({"doc_id": F.xxhash64("conv_id", "turn"), "loss": F.col("role") == "assistant"})
    rows = [tuple(r) for r in packing.pack(turns, queries.word_vocabulary(), 256, 16, 100, loss="loss").collect()]
    parts = defaultdict(list)
    for r in rows:
        parts[r[0]].append(r)
    check_pieces(rows, {k: b"".join(p[3] for p in sorted(v, key=lambda p: p[1])) for k, v in parts.items()}, 256, 16, 100)
    assert any(r[7] for r in rows) and {r[0] for r in rows} == {r.doc_id for r in turns.select("doc_id").collect()}


# --- op13 -----------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_ranks(docs, items, k):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, Counter(t), len(t)) for i, t in texts if t]
    n, words = len(texts), sum(x[2] for x in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = Counter()
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, size in texts:
            m = 75 + 25 * size * n // words
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out.update((item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.mark.parametrize("shard, slice_", [(1 << 15, 4 << 20), (3, 10)])
def test_ranks_equal_brute_force(spark, monkeypatch, shard, slice_):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", slice_)
    rng = random.Random(2)
    word = lambda: rng.choice(["one", "Two", "drei", "été", "Ünder", "x1", "the", "the", "a_b"])
    docs = [(rng.choice([i, i, 5]), " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(120)]
    docs += [(-1, None), (-2, ""), (-3, "... --"), (None, "one two"), (None, "drei"), (-4, "the " * 20_000), (-5, "same text"), (-6, "same text"), (-6, "same text")]
    items = [(1, "the one ONE été"), (2, None), (3, ""), (4, "absent"), (5, "same"), (5, "same text the"), (None, "a_b x1"), (6, "ünder Ünder")]
    index = ranked_search.build_index(clashing(spark.createDataFrame(docs, DOCS).repartition(3)))
    asked = clashing(spark.createDataFrame(items, "item_id int, text string"))
    for k in (4, 20):
        assert Counter(tuple(r) for r in ranked_search.search(index, asked, k).collect()) == naive_ranks(docs, items, k)
    assert ranked_search.search(index, asked.limit(0)).count() == 0
    none = ranked_search.build_index(spark.createDataFrame([], DOCS))
    assert ranked_search.search(none, asked).count() == 0
