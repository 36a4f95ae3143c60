"""Every query with SQL against the database, on the smallest tables."""

import pytest

import __spark_entry__ as e
from tests.compare import database, difference

_SQL = e.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert difference(e.queries()[name](spark, sf), con, _SQL[name]) is None


def test_names_agree():
    assert set(_SQL) <= set(e.queries())
