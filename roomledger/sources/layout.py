"""How the large tables are stored so that the queries read little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parts_of(spark: SparkSession) -> int:
    """Partitions for rows that are small when they are exchanged and large afterwards. Spark
    joins small partitions by their compressed bytes, unless their number is given."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def write_clustered(
    df: DataFrame, path: str, column: str | list[str], files: int | None = None
) -> None:
    """Parquet whose files and row groups each hold a narrow range of ``column``, or columns.

    A time window then skips every row group outside it by its statistics.
    Ranges are split by sampled quantiles, so a busy day is spread over files.
    """
    columns = [column] if isinstance(column, str) else column
    ranged = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Catalog table in buckets of ``key``: joins on it need no shuffle of it."""
    writer = df.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
