"""Status changes, access rates and channel health as streams.

Progress and state live under the checkpoint path the caller gives, else in a
folder per job below ``spark.checkpoint.dir``, the shared folder of the
session.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roomledger.operators.changes import apply_status_changes, latest_changes
from roomledger.operators.channels import request_rate, sync_health
from roomledger.plans.stored import file_system

CHANGE_SCHEMA = "change_id bigint, booking_id bigint, status string, changed_at timestamp"
LOG_SCHEMA = """id bigint, ota_configuration_id bigint, status string,
                sync_started_at timestamp, records_processed int"""
ACCESS_SCHEMA = "client_id bigint, ts timestamp"


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder of the session, else ``fallback``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return root


def read_feed(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    )


def create_store(spark: SparkSession, store: str) -> None:
    """An empty change store, unless there is one."""
    spark.createDataFrame([], CHANGE_SCHEMA).write.mode("ignore").parquet(f"{store}/run=none")


def runs_of(spark: SparkSession, store: str) -> list[str]:
    """The folders of a store: one for every checkpoint a stream was started with."""
    place, files = file_system(spark, store)
    if not files.exists(place):
        return []
    found = [str(entry.getPath()) for entry in files.listStatus(place) if entry.isDirectory()]
    return sorted(path for path in found if path.rsplit("/", 1)[-1].startswith("run="))


def collect_status_changes(
    changes: DataFrame,
    store: str,
    checkpoint: str | None = None,
    retention: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Appends the change feed to the store that ``current_bookings`` reads.

    Spark's file sink writes every batch once: its log, which readers follow, names the
    files of finished batches. The log counts batches as the checkpoint does, so each
    checkpoint has a folder of its own, ``run=`` and the digest of its path. A
    checkpoint that was emptied while its folder stayed would have its first batches
    taken for done, and is refused. With ``retention`` (such as "30 days") the sink forgets
    older files, which ``compact_changes`` has to have folded by then.
    """
    spark = changes.sparkSession
    progress = checkpoint or f"{checkpoint_root(spark)}/status_changes"
    run = f"{store}/run={hashlib.sha256(progress.encode()).hexdigest()[:16]}"
    begun, files = file_system(spark, f"{progress}/offsets")
    if not files.exists(begun) and run.rsplit("/", 1)[-1] in [r.rsplit("/", 1)[-1] for r in runs_of(spark, store)]:
        raise ValueError(f"{progress} was emptied but {run} was not: use another checkpoint")
    write = changes.select(*[F.col(f.split()[0]) for f in CHANGE_SCHEMA.split(", ")]).writeStream
    if retention:
        write = write.option("retention", retention)
    return (
        write.format("parquet")
        .outputMode("append")
        .option("path", run)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def stored_changes(spark: SparkSession, store: str, compacted: str | None = None) -> DataFrame:
    """All changes of finished batches; a path that holds no store is an error.

    A change may be there more than once, in the compacted table and in a run, or in two
    runs of the same feed; the latest one of a booking is the same.
    """
    paths = runs_of(spark, store) or [store]
    paths += [compacted] if compacted else []
    # each folder by itself: only then does Spark read it by the log of its sink
    parts = [spark.read.schema(CHANGE_SCHEMA).parquet(path) for path in paths]
    return functools.reduce(DataFrame.unionByName, parts)


def compact_changes(
    spark: SparkSession, store: str, target: str, compacted: str | None = None
) -> None:
    """Writes the latest change of every booking, of the runs and an earlier compacted table,
    as a new table. An ordinary batch job: it may fail, be repeated and run beside the stream."""
    latest_changes(stored_changes(spark, store, compacted)).select(
        "change_id", "booking_id", "status", "changed_at"
    ).write.parquet(target)


def current_bookings(bookings: DataFrame, store: str, compacted: str | None = None) -> DataFrame:
    """Bookings as of the last finished batch of the change stream."""
    return apply_status_changes(bookings, stored_changes(bookings.sparkSession, store, compacted))


def request_rate_stream(
    log: DataFrame, width: str = "15 minutes", limit: int = 100, late: str = "15 minutes"
) -> DataFrame:
    """Closed windows of ``request_rate``; rows later than ``late`` are dropped."""
    return request_rate(log, width, limit, late)


def sync_health_stream(logs: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Closed windows of ``sync_health``."""
    return sync_health(logs, width, late)


def write_closed_windows(
    windows: DataFrame, path: str, job: str, checkpoint: str | None = None, **trigger
) -> StreamingQuery:
    progress = checkpoint or f"{checkpoint_root(windows.sparkSession)}/{job}"
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def batch_column(df: DataFrame) -> DataFrame:
    """Batch rows typed as a stream needs them: zone-aware times in UTC."""
    zoned = [
        F.col(name).cast("timestamp").alias(name) if kind == "timestamp_ntz" else F.col(name)
        for name, kind in df.dtypes
    ]
    return df.select(*zoned)
