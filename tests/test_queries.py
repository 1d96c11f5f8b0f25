import pytest
from pyspark.sql import DataFrame

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference
from driftledger.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    found = entry(spark)
    assert isinstance(found, DataFrame) and found.columns == ["target", "version", "file", "status", "detail"]
    assert found.count() > 0


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_duckdb(spark, duck, name):
    count, problem = difference(spark, duck, SF, name)
    assert problem is None
    assert count > 0
