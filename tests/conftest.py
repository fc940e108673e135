from __future__ import annotations

import datetime as dt
import decimal
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roomledger.session import build_session  # noqa: E402
from roomledger.sources.schema import schema_of  # noqa: E402
from roomledger.sources.tables import Tables  # noqa: E402

STAR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _typed(value, kind: str):
    if value is None:
        return None
    if kind.startswith("decimal"):
        return decimal.Decimal(str(value))
    if kind == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if kind == "timestamp_ntz" and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from rows as dicts; columns left out are null, tables left out empty."""

    def build(**given) -> Tables:
        def load(name: str):
            schema = schema_of(name)
            rows = [
                tuple(_typed(row.get(f.name), f.dataType.simpleString()) for f in schema.fields)
                for row in given.get(name, [])
            ]
            return spark.createDataFrame(rows, schema)

        return Tables(load)

    return build


def rows_of(df, *names: str) -> list[tuple]:
    return [tuple(row) for row in (df.select(*names) if names else df).collect()]
