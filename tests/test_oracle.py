"""Every registered query against DuckDB on the small tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point
from trafficlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(entry_point.queries()[name](spark, SF), con, entry_point.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
