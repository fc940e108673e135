"""Side-by-side run of a Spark query and its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark type -> the DuckDB type it must meet.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def database(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimals are not compared")
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, float):
        return repr(value)
    return value


def _bag(rows):
    return sorted([tuple(_plain(v) for v in row) for row in rows], key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Reasons why the two results differ; empty when they agree."""
    names = sorted(df.columns)
    shape = con.execute(f"DESCRIBE {sql}").fetchall()
    wanted = {row[0]: row[1] for row in shape}
    if sorted(wanted) != names:
        return [f"columns {sorted(wanted)} vs {names}"]
    found = []
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != wanted[name]:
            found.append(f"type of {name}: {kind} vs {wanted[name]}")
    listed = ", ".join(f'"{n}"' for n in names)
    expected = _bag(con.execute(f"SELECT {listed} FROM ({sql})").fetchall())
    actual = _bag([tuple(row) for row in df.select(*names).collect()])
    if len(expected) != len(actual):
        found.append(f"rows: spark {len(actual)} vs sql {len(expected)}")
    if expected != actual:
        for spark_row, sql_row in zip(actual, expected):
            if spark_row != sql_row:
                found.append(f"{names}\n spark {spark_row}\n sql   {sql_row}")
                break
    return found
