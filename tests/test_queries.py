"""Every named query against its SQL on the smallest test data."""

import pytest

import __spark_entry__ as entry
from kbspark.plans.catalog import QUERIES
from kbspark.plans.oracle import ORACLES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    error, rows = compare(spark, duck, SF, QUERIES[name], ORACLES[name])
    assert error is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
