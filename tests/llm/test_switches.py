"""Results do not change where a size switches the plan: each switch at a lowered value."""

import os

import pytest

from annalist.llm import near_dedup, quality_rules
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def documents(spark):
    odd = spark.createDataFrame([(-1, None, None), (-2, "a b c a b c a b d " * 40, "en"), (-3, "x y " * 400, "xx"), (-4, "p q r s " * 3 + "p q r", "de")], "doc_id long, text string, lang string")
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd).cache()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name, value", [("PACKED_WORDS", 4), ("BROADCAST_LANGUAGES", 1)])
def test_quality_rules(documents, monkeypatch, name, value):
    want = rows(quality_rules.judge(documents))
    monkeypatch.setattr(quality_rules, name, value)
    assert rows(quality_rules.judge(documents)) == want


def test_near_dedup(documents, monkeypatch):
    want = rows(near_dedup.classes(documents))
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 8)  # all documents share the bitmap's slots
    assert rows(near_dedup.classes(documents)) == want
