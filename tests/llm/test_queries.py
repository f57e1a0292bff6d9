"""The registered queries next to their SQL."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from pharmasift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_one_query_per_operator_and_the_pipeline():
    assert sorted((name.split("_")[0] for name in QUERIES), key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 14)]
    assert "pipeline" in queries() and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF).startswith("ok")
