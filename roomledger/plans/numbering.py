"""Exact row numbers over whole tables and inside groups of any size.

``row_number`` over a hot group sorts the whole group in one task. Here rows are dealt
out by ranges of their order, sorted within a range and stored once with their range and
place; the counts of the ranges before shift the places. Spark samples the bounds of
the ranges, so these hold about the same number of rows however the values are spread.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.plans.stored import stored

RANGES_AT_LEAST = 8
#: ``monotonically_increasing_id`` counts a partition's rows in its low 33 bits.
_PLACES = (1 << 33) - 1


def _ranges(spark: SparkSession) -> int:
    return max(RANGES_AT_LEAST, int(spark.conf.get("spark.sql.shuffle.partitions")))


def positions(df: DataFrame, order: list[Column], alias: str, ranges: int | None = None) -> DataFrame:
    """Position of each row of the table in ``order``, from 1.

    Rows that are equal in all of ``order`` follow each other in any order. One count per
    range reaches the driver, and as many rows are joined to give the offsets.
    """
    spark = df.sparkSession
    parts = ranges or _ranges(spark)
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)))
    )
    held = stored(placed, "numbered")
    counted = sorted(tuple(row) for row in held.groupBy("_range").count().collect())
    before = accumulate((n for _, n in counted), initial=0)
    offsets = [f"({part}, {shift}L)" for (part, _), shift in zip(counted, before)]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(offsets or ['(-1, 0L)'])} AS t(_range, _before)")
    return (
        held.join(table, "_range")
        .withColumn(alias, F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_place", "_before")
    )


def number_rows(df: DataFrame, key: Column, alias: str, ranges: int | None = None) -> DataFrame:
    """Position of each row of the table by the unique ``key``, from 1; null where it is null.

    Rows without a key come last and are spread, however many they are.
    """
    keyed = df.withColumn("_key_", key)
    spread = F.when(F.col("_key_").isNull(), F.monotonically_increasing_id())
    placed = positions(keyed.withColumn("_spread", spread), [F.asc_nulls_last("_key_"), F.col("_spread")], alias, ranges)
    number = F.when(F.col("_key_").isNotNull(), F.col(alias))
    return placed.withColumn(alias, number).drop("_key_", "_spread")


def number_within(
    df: DataFrame, group: str, unique_id: str, alias: str, ranges: int | None = None
) -> DataFrame:
    """Position of each row in its group by ``unique_id``, counted from 1."""
    placed = positions(df, [F.col(group), F.col(unique_id)], "_position", ranges)
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_position").alias("_first"))
    return (
        placed.join(first, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(alias, F.col("_position") - F.col("_first") + 1)
        .drop("_position", "_group", "_first")
    )
