"""Every query against its check SQL on the smallest tables."""

import os

import oracle
import pytest

from procatlas.plans.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, name):
    difference = oracle.compare(QUERIES[name](spark, SF), con, CHECKS[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).limit(5).count() == 5
