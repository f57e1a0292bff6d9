import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from workload.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["drug_key", "pt", "prr"]
    got = [r.prr for r in df.collect()]
    assert len(got) > 20 and got == sorted(got, reverse=True)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(queries()) and set(REGISTRY) <= set(oracle_sql()) and len(REGISTRY) > 130


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF).startswith("ok")
