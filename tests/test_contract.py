"""Every registered query against its SQL, on the smallest tables, with a look at its plan."""

import pytest

import __spark_entry__ as contract
from contract.compare import database, difference
from contract.queries import QUERIES
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def connection(small):
    return database(small)


def test_every_query_has_sql():
    assert set(QUERIES) <= contract.queries().keys()
    assert set(QUERIES) <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, connection, name):
    df = contract.queries()[name](spark, small)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan
    assert difference(df, connection, contract.oracle_sql()[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 10
