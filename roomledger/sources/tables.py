"""The bundle of lodging tables and the ways to load it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.plans.stored import replaced
from roomledger.sources.schema import TABLE_NAMES, schema_of


class Tables:
    """One DataFrame per lodging table, built when first asked for.

    ``t.bookings`` and its like call ``load`` once each, so a query plans only
    the tables it touches.
    """

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._load(name)
        return self._built[name]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in TABLE_NAMES]


def load_tables(spark: SparkSession, path: str, file_format: str = "parquet") -> Tables:
    """Tables stored as ``<path>/<table>``.

    The declared schema is given to the reader: no footer is sampled on the
    driver, and secrets that a file may hold are outside the read schema.
    """

    def load(name: str) -> DataFrame:
        return spark.read.format(file_format).schema(schema_of(name)).load(f"{path}/{name}")

    return Tables(load)


def jdbc_options(
    table: str, url: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Reader options for a scan of a live table in ranges of its id.

    A table without an id is cut by its first column.
    """
    columns = schema_of(table).fieldNames()
    names = ", ".join(columns)
    return {
        "url": url,
        # A column list instead of the table keeps secrets in the database.
        "dbtable": f"(SELECT {names} FROM {table}) src",
        "partitionColumn": "id" if "id" in columns else columns[0],
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
    }


def read_jdbc(
    spark: SparkSession,
    table: str,
    url: str,
    lower: int,
    upper: int,
    partitions: int,
    **properties: str,
) -> DataFrame:
    """Parallel scan of one table of a live database, typed as declared."""
    options = jdbc_options(table, url, lower, upper, partitions)
    raw = spark.read.format("jdbc").options(**options).options(**properties).load()
    return raw.select(*[raw[f.name].cast(f.dataType) for f in schema_of(table).fields])


def table_sizes(tables: Tables) -> DataFrame:
    """Row count of every table of the bundle."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total


def store_tables(tables: Tables, path: str) -> None:
    """Writes every table of the bundle where ``load_tables`` finds it."""
    for name, df in tables.items():
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name).fields]
        replaced(df.sparkSession, f"{path}/{name}", df.select(*typed).write.parquet)


def table_contents(tables: Tables) -> DataFrame:
    """Row count of every table and the sum of its rows' hashes, which orders do not change."""
    parts = [
        df.select(F.xxhash64(*[F.col(f.name) for f in schema_of(name).fields]).alias("h")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("contents"),
        ).select(F.lit(name).alias("table_name"), "row_count", "contents")
        for name, df in tables.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)
