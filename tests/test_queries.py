"""Every query that has SQL gives the same rows."""

import os

import oracle
import pytest

from claimloom.plans import core_queries, record_queries

QUERIES = {**core_queries.QUERIES, **record_queries.QUERIES}
SQL = {**core_queries.SQL, **record_queries.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="test data absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    oracle.same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0].score >= rows[-1].score
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
