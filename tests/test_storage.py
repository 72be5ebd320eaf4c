"""The versioned store and the segmented index."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from annalist.operators import index as index_module, search
from annalist.operators.index import Index
from annalist.storage import Conflict, Store

VECTORS = "id string, embedding array<float>"


def rows(spark, *ids):
    return spark.createDataFrame([(i, [1.0]) for i in ids], VECTORS)


def ids(version):
    return sorted(r.id for r in version.table("vector").collect())


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version().number == 0 and ids(store.version()) == []
    with store.transaction() as t:
        t.replace(rows(spark, "a"), "vector")
        t.append(rows(spark, "b"), "vector")
        t.keep("n", {"x": 1})
        assert ids(t) == ["a", "b"] and ids(store.version()) == []  # seen by itself alone
    first = store.version()
    reader = first.table("vector")
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.replace(rows(spark, "z"), "vector")
        1 / 0
    assert store.version().number == first.number == 1 and ids(store.version()) == ["a", "b"] and first.facts("n") == {"x": 1}
    with store.transaction() as t:
        t.append(rows(spark, "c"), "vector")
    assert ids(store.version()) == ["a", "b", "c"] and sorted(r.id for r in reader.collect()) == ["a", "b"] and ids(store.version(1)) == ["a", "b"]


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(Conflict), store.transaction() as slow:
        slow.replace(rows(spark, "slow"), "vector")
        with store.transaction() as quick:
            quick.replace(rows(spark, "quick"), "vector")
    assert ids(store.version()) == ["quick"] and store.numbers() == [1]


def test_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        with store.transaction() as t:
            t.replace(rows(spark, str(i)), "vector")
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.replace(rows(spark, "lost"), "vector")
        1 / 0
    assert store.vacuum() == 0 and store.numbers() == [3, 4]  # data folders are too young
    assert store.vacuum(keep=1, seconds=0) == 4 and store.numbers() == [4] and ids(store.version()) == ["3"]
    assert len(os.listdir(tmp_path / "data")) == 1
    (tmp_path / "versions" / "000000000005.json.abc.tmp").write_text("half")  # what a writer left that died as it committed
    os.utime(tmp_path / "versions" / "000000000005.json.abc.tmp", (time.time() - 9999,) * 2)
    assert store.version().number == 4 and store.vacuum() == 0 and sorted(n for n in os.listdir(tmp_path / "versions") if not n.startswith(".")) == ["000000000004.json"]


def scores(fitted, asked):
    return {(r.query_id, r.id): round(r.score, 9) for r in search.bm25_search(fitted, asked).collect()}


def test_the_index_equals_a_full_fit_after_any_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "MOST_SEGMENTS", 3)
    rng = random.Random(4)
    words = ["login", "tokenCheck", "rate_limit", "the", "the", "of", "tea", "HTTPServer", "x1"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 9)))])
    asked = spark.createDataFrame([(0, "the tea login"), (1, "rate limit server"), (2, "x1 absent")], "query_id int, query string")
    now, index, compacted = {}, Index(spark, str(tmp_path)), 0
    for step in range(6):
        put = {f"d{rng.randint(0, 40)}": text() for _ in range(12)}
        gone = rng.sample(sorted(now), min(len(now), 4)) + ["never there"]
        gone = [i for i in gone if i not in put]
        if step % 2:  # by comparison of the whole tables
            after = {i: t for i, t in {**now, **put}.items() if i not in gone}
            frame = lambda d: spark.createDataFrame(sorted(d.items()), "id string, text string")
            index = index.follow(frame(now), frame(after))
        else:
            index = index.changed(spark.createDataFrame(sorted(put.items()), "id string, text string"), spark.createDataFrame([(i,) for i in gone], "id string"))
            after = {i: t for i, t in {**now, **put}.items() if i not in gone}
        if index.needs_compaction():
            index, compacted = index.compacted(), compacted + 1
        now = after
        whole = search.bm25_fit(spark.createDataFrame(sorted(now.items()), "id string, text string"))
        assert scores(index.fitted(), asked) == scores(whole, asked), step
        again = Index(spark, str(tmp_path), index.facts)
        assert {r.term: r.df for r in again.counts().collect()} == {r.term: r["n"] for r in whole[0].groupBy("term").agg(F.countDistinct("id").alias("n")).collect()}
    assert compacted and len(index.facts["segments"]) <= 4
    assert index.changed(spark.createDataFrame([], "id string, text string"), spark.createDataFrame([("never",)], "id string")) is index
    empty = Index(spark, str(tmp_path))
    assert scores(empty.fitted(), asked) == {}


def test_a_query_reads_only_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"common word{i}") for i in range(50)], "id string, text string")
    index = Index(spark, str(tmp_path)).changed(docs, spark.createDataFrame([], "id string"))
    asked = spark.createDataFrame([(0, "word7")], "query_id int, query string")
    plan = search.bm25_search(index.fitted(), asked)._jdf.queryExecution().toString()
    assert plan.count("In(term, [") >= 2  # of the scans of postings and of counts
