"""Counting points below and beyond others in two dimensions, without pairing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days since year 1 fit so many bits, whatever the dates.
LEVELS = 22


def count_before_and_beyond(points: DataFrame, asked: DataFrame, group: str, alias: str) -> DataFrame:
    """``asked`` (group, x, y) with the number of points of its group whose x is earlier and
    whose y is later; ``points`` (group, x, y, n) count n times. x and y are dates.

    Days before x are a few dyadic blocks of days, one per set bit of its number, and a
    point lies in one block of every size. Within a block only y matters: points are folded
    per day and summed up from the latest, so a block has at most as many rows as the
    calendar days, however many points share them. Every join is on equal block and day.
    """
    first = F.expr("DATE '0001-01-01'")

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_x", F.date_diff("x", first))

    levels = f"sequence(0, {LEVELS - 1})"
    held = F.expr(
        f"inline(transform(filter({levels}, k -> shiftright(_x, k) % 2 = 0), k -> (k AS size, shiftright(_x, k) AS block)))"
    )
    needed = F.expr(
        f"inline(transform(filter({levels}, k -> shiftright(_x, k) % 2 = 1), k -> (k AS size, shiftright(_x, k) - 1 AS block)))"
    )
    block = [group, "size", "block"]
    there = numbered(points).select(group, "y", "n", held)
    wanted = numbered(asked).select(group, "x", "y", needed)
    days = there.unionByName(wanted.select(*block, "y", F.lit(0).cast("bigint").alias("n")))
    folded = days.groupBy(*block, "y").agg(F.sum("n").alias("n"))
    later = Window.partitionBy(*block).orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = folded.withColumn("_beyond", F.coalesce(F.sum("n").over(later), F.lit(0))).drop("n")
    return (
        wanted.join(beyond, [*block, "y"])
        .groupBy(group, "x", "y")
        .agg(F.sum("_beyond").cast("bigint").alias(alias))
    )
