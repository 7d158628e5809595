"""The corpus queries that SQL can express, on the test tables."""

import pytest

from cairn.llm import queries
from tests.oracle import MISSING, assert_same


@pytest.mark.skipif(MISSING, reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
