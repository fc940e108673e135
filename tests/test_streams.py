"""A stream run to its end gives what the batch gives."""

from __future__ import annotations

import datetime as dt
import pathlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from roomledger.operators.changes import apply_status_changes
from roomledger.operators.channels import request_rate, sync_health
from roomledger.sources.starmap import StarSource
from roomledger.streaming import feeds
from tests.conftest import STAR, rows_of

ONCE = {"availableNow": True}


def _split(df, path: str, parts: int = 3) -> None:
    """Writes the rows in time order, one file per part."""
    for part in range(parts):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)


def test_status_changes(spark, tmp_path):
    src = StarSource(spark, STAR)
    changes = feeds.batch_column(src.status_changes())
    _split(changes.withColumn("part", F.col("change_id") % 3), str(tmp_path / "in"))
    feed = feeds.read_feed(spark, str(tmp_path / "in"), feeds.CHANGE_SCHEMA, max_files=1)
    store = str(tmp_path / "store")
    with pytest.raises(AnalysisException):
        feeds.current_bookings(src.bookings(), store)
    feeds.create_store(spark, store)
    assert feeds.current_bookings(src.bookings(), store).count() == src.bookings().count()
    cp = str(tmp_path / "cp")
    feeds.collect_status_changes(feed, store, cp, **ONCE).awaitTermination()
    streamed = feeds.current_bookings(src.bookings(), store)
    batch = apply_status_changes(src.bookings(), src.status_changes())
    names = ("id", "booking_status", "updated_at")
    assert sorted(rows_of(streamed, *names)) == sorted(rows_of(batch, *names))
    # every change is there once; a restart finds nothing new and changes nothing
    every = feeds.batch_column(src.status_changes())
    assert sorted(rows_of(feeds.stored_changes(spark, store), "change_id")) == sorted(rows_of(every, "change_id"))
    feeds.collect_status_changes(feed, store, cp, **ONCE).awaitTermination()
    assert feeds.stored_changes(spark, store).count() == every.count()
    assert sorted(rows_of(feeds.current_bookings(src.bookings(), store), *names)) == sorted(rows_of(batch, *names))
    # A new checkpoint starts at batch 0 again and overwrites nothing.
    (tmp_path / "in2").mkdir()
    later = every.where("change_id < 50").selectExpr(
        "change_id + 1000000 AS change_id", "booking_id", "'no_show' AS status",
        "changed_at + INTERVAL 100 YEARS AS changed_at",
    )
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    second = feeds.read_feed(spark, str(tmp_path / "in2"), feeds.CHANGE_SCHEMA)
    feeds.collect_status_changes(second, store, str(tmp_path / "cp2"), **ONCE).awaitTermination()
    assert len(feeds.runs_of(spark, store)) == 3
    wanted = sorted(rows_of(apply_status_changes(src.bookings(), every.unionByName(later)), *names))
    assert sorted(rows_of(feeds.current_bookings(src.bookings(), store), *names)) == wanted
    # Replaying the whole feed from a third checkpoint changes nothing either.
    feeds.collect_status_changes(feed, store, str(tmp_path / "cp3"), **ONCE).awaitTermination()
    assert feeds.stored_changes(spark, store).count() == 2 * every.count() + later.count()
    assert sorted(rows_of(feeds.current_bookings(src.bookings(), store), *names)) == wanted
    # The compacted table holds one change per booking and stands in for the runs.
    feeds.compact_changes(spark, store, str(tmp_path / "folded"))
    folded = spark.read.parquet(str(tmp_path / "folded"))
    assert folded.count() == every.where("status IN ('pending','confirmed','cancelled','completed','no_show')").unionByName(later).select("booking_id").distinct().count()
    fresh = str(tmp_path / "fresh")
    feeds.create_store(spark, fresh)
    only = feeds.current_bookings(src.bookings(), fresh, str(tmp_path / "folded"))
    assert sorted(rows_of(only, *names)) == wanted
    both = feeds.current_bookings(src.bookings(), store, str(tmp_path / "folded"))
    assert sorted(rows_of(both, *names)) == wanted
    feeds.compact_changes(spark, fresh, str(tmp_path / "again"), str(tmp_path / "folded"))
    assert sorted(rows_of(spark.read.parquet(str(tmp_path / "again")))) == sorted(rows_of(folded))


def test_unfinished_files_are_not_read_and_an_emptied_checkpoint_is_refused(spark, tmp_path):
    rows = [(i, i, "cancelled", dt.datetime(2024, 1, 1)) for i in range(6)]
    changes = spark.createDataFrame(rows, feeds.CHANGE_SCHEMA)
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = feeds.read_feed(spark, str(tmp_path / "in"), feeds.CHANGE_SCHEMA)
    store, cp = str(tmp_path / "store"), tmp_path / "cp"
    feeds.collect_status_changes(feed, store, str(cp), **ONCE).awaitTermination()
    (run,) = feeds.runs_of(spark, store)
    path = run.removeprefix("file:")
    # what a task leaves that died in the middle of its batch
    (pathlib.Path(path) / "part-00099-dead.snappy.parquet").write_bytes(b"PAR1 half")
    assert feeds.stored_changes(spark, store).count() == 6
    cp.rename(tmp_path / "gone")
    with pytest.raises(ValueError, match="another checkpoint"):
        feeds.collect_status_changes(feed, store, str(cp), **ONCE)


def _closed(spark, tmp_path, df, schema, windows_of, time_column):
    """Windows written by a stream over ``df`` and the end of its watermark."""
    _split(df.withColumn("part", F.lit(0)), str(tmp_path / "in"), 1)
    stream = feeds.read_feed(spark, str(tmp_path / "in"), schema)
    out = str(tmp_path / "out")
    query = feeds.write_closed_windows(
        windows_of(stream), out, "windows", str(tmp_path / "cp"), **ONCE
    )
    query.awaitTermination()
    newest = df.agg(F.max(time_column)).first()[0]
    return spark.read.parquet(out), newest


def test_request_rate(spark, tmp_path):
    log = feeds.batch_column(StarSource(spark, STAR).access_log())
    got, newest = _closed(
        spark,
        tmp_path,
        log,
        feeds.ACCESS_SCHEMA,
        lambda s: feeds.request_rate_stream(s, limit=1, late="15 minutes"),
        "ts",
    )
    cut = newest - dt.timedelta(minutes=30)
    whole = request_rate(log, limit=1).where(F.col("window_start") <= F.lit(cut))
    expected = rows_of(whole)
    assert expected
    assert sorted(rows_of(got.where(F.col("window_start") <= F.lit(cut)))) == sorted(expected)


def test_sync_health(spark, tmp_path):
    logs = feeds.batch_column(StarSource(spark, STAR).ota_sync_logs()).select(
        "id", "ota_configuration_id", "status", "sync_started_at", "records_processed"
    )
    got, newest = _closed(
        spark, tmp_path, logs, feeds.LOG_SCHEMA, feeds.sync_health_stream, "sync_started_at"
    )
    cut = newest - dt.timedelta(hours=2)
    expected = rows_of(sync_health(logs).where(F.col("window_start") <= F.lit(cut)))
    assert expected
    assert sorted(rows_of(got.where(F.col("window_start") <= F.lit(cut)))) == sorted(expected)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    hour = lambda h: dt.datetime(2024, 6, 15, h)
    batches = [[(1, hour(1)), (1, hour(9))], [(1, hour(2)), (1, hour(10))], [(1, hour(20))]]
    stream = None
    for rows in batches:
        spark.createDataFrame(rows, feeds.ACCESS_SCHEMA).coalesce(1).write.mode("append").parquet(
            path
        )
        stream = feeds.read_feed(spark, path, feeds.ACCESS_SCHEMA)
        feeds.write_closed_windows(
            feeds.request_rate_stream(stream),
            str(tmp_path / "out"),
            "request_rate",
            str(tmp_path / "cp"),
            **ONCE,
        ).awaitTermination()
    starts = [r[0].hour for r in rows_of(spark.read.parquet(str(tmp_path / "out")), "window_start")]
    assert sorted(starts) == [1, 9, 10]


def test_checkpoint_root_is_the_folder_of_the_session():
    class Session:
        conf = {"spark.checkpoint.dir": "/cluster/cp"}

    class Bare:
        conf: dict = {}

    assert feeds.checkpoint_root(Session, "/shared/cp") == "/cluster/cp"
    assert feeds.checkpoint_root(Bare, "/shared/cp") == "/shared/cp"
    with pytest.raises(ValueError):
        feeds.checkpoint_root(Bare)
