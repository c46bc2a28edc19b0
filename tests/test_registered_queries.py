"""Every registered query against its SQL on the same tables."""

import pytest

from checks import registry
from checks.compare import connect, diff

from .conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert diff(got, duck.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert 0 < entry(spark).count() <= 10
