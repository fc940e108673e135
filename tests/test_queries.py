"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from roomledger import catalog, oracle
from tests.compare import database, differences
from tests.conftest import STAR

SQL = oracle.statements()
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    return database(STAR)


def test_every_query_has_sql_and_the_reverse():
    assert set(SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = catalog.run(name, spark, STAR)
    assert not differences(df, duck, SQL[name])


def test_entry_has_rows(spark):
    result = driver.entry(spark)
    assert result.columns == ["category_name", "revenue", "bookings", "avg_value"]
    assert result.count() == 5
