"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, ``spark.checkpoint.dir``.

    Only a local session may leave it unset and gets a folder of this machine; on a
    cluster that is an error, since executors would not find each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="roomledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, job: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage, safe against
    lost executors. The files are deleted by ``discard`` or when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    place, files = file_system(spark, path)
    files.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing computed later is read from."""
    for df in tables:
        place, files = file_system(df.sparkSession, df.stored_at)
        files.delete(place, True)


def replaced[T](spark: SparkSession, path: str, write: Callable[[str], T]) -> T:
    """Calls ``write`` with a folder beside ``path`` and puts it in the place of ``path``.

    A write that fails leaves what was there. The folders change places by two renames; if
    the second fails, the first is undone.
    """
    target = path.rstrip("/")
    staged, aside = (f"{target}-{what}-{uuid.uuid4().hex}" for what in ("staged", "old"))
    new, files = file_system(spark, staged)
    old, place = (file_system(spark, p)[0] for p in (aside, target))
    try:
        result = write(staged)
    except BaseException:
        files.delete(new, True)
        raise
    there = files.exists(place)
    if there and not files.rename(place, old):
        raise OSError(f"{path} could not be moved; the new data are in {staged}")
    if not files.rename(new, place):
        if there:
            files.rename(old, place)
        raise OSError(f"{path} could not be replaced; the new data are in {staged}")
    if there:
        files.delete(old, True)
    return result
