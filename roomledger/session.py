"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Plain Spark settings; all of them may be overridden by spark-submit.
RECOMMENDED = {
    # Stored times are zone-free; pin the zone so casts never move a day.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where that costs one more exchange: one guest,
    # room or channel may own a third of the rows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Deep pages sort on the executors instead of gathering on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Recording the Python line of every column expression costs more than
    # planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "32",
}


def build_session(
    app_name: str = "roomledger",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with ``RECOMMENDED``; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
