"""Every registered query against its SQL, whole results, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, duck

Q, O = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(O))
def test_matches_sql(spark, sf, con, name):
    assert compare(Q[name](spark, sf).toPandas(), con.execute(O[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs_with_stable_schema(spark, sf, name):
    a, b = Q[name](spark, sf), Q[name](spark, sf)
    assert a.schema == b.schema
    assert a.count() > 0


def test_registry_is_consistent():
    assert set(O) <= set(Q)


def test_entry(spark):
    assert entry(spark).count() == 4
