"""Every query of the subpackage that has SQL gives the same rows; the others run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402

from claimloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="test data absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    oracle.same(spark, oracle.connect(), queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, oracle.DATA).count() >= 0
