"""The operators that SQL can express, against DuckDB."""

import os

import pytest

from annalist.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.test_oracle import duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
