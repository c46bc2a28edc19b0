"""Registered queries of this package against their SQL."""

import os

import duckdb
import pytest

from tests.conftest import SF
from wattframe.llm import queries as registered


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{SF}/{file}'")
    return db


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registered.queries()[name](spark, SF).toPandas()
    want = duck.execute(registered.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))) for df in (got, want)]
    assert rows[0] == rows[1] and len(got)
