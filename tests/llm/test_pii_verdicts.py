"""op9: candidates of one kind on both sides of the verdict."""

import os

import pytest

from annalist.llm import pii
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_numbers_are_told_apart(spark):
    own = [(i, f"You can call me or phone my office at 555-{100 + i}-{4000 + i} in the evening.") for i in range(30)]
    bare = [(100 + i, f"We saw 123456789{i:02} of them there.") for i in range(30)]
    years = [(200 + i, f"It rained in 2019 2020 20{10 + i} and after.") for i in range(30)]
    planted = spark.createDataFrame(own + bare + years, "doc_id long, text string")
    whole = planted.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    got = {r.doc_id: r.spans for r in pii.detect(whole).collect()}
    assert {pii.candidates(t)[1][0][0] for _, t in own + bare + years} == {"number"}
    assert all(got[i] == f"number:{t.index('555')}:{t.index(' in the')}" for i, t in own)
    assert not any(got[i] for i, _ in bare + years)
