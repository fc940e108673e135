"""Tables in the shared folder, document columns and salted numbering."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.plans.stored import discard, shared_folder, stored

__all__ = ["discard", "shared_folder", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict[str, object] = {}


def release_worker() -> None:
    """Gives back what earlier stages left in this Python worker: workers go on to the next
    stages of an application, and their memory adds up to the executor's."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_cache(build):
    """``build`` with its last value kept in the Python worker, one such value in all."""

    @functools.wraps(build)
    def get(*key):
        owner = (build.__module__, build.__qualname__, key)
        if _HELD.get("owner") != owner:
            release_worker()
            _HELD.update(owner=owner, value=build(*key))
        return _HELD["value"]

    return get


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that tasks
    find it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        with tempfile.TemporaryDirectory() as clean:
            shutil.copytree(
                os.path.join(root, "roomledger"),
                os.path.join(clean, "roomledger"),
                ignore=shutil.ignore_patterns("__pycache__"),
            )
            name = os.path.join(tempfile.mkdtemp(prefix="roomledger-"), "roomledger_tasks")
            context.addPyFile(shutil.make_archive(name, "zip", clean))
        _SHIPPED.add(context.applicationId)


def documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str
) -> DataFrame:
    """``(doc_id, text, *more)`` alone, so that no other column can clash; null texts are empty."""
    ship(df.sparkSession)
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )


#: Bits of the bitmaps below: 1,024 rows of 4 KB at most, whatever the number of ids.
FILTER_BITS = 1 << 25


def _filter_place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(FILTER_BITS))


def marked(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``id_col`` is not among ``ids.doc_id``.

    A bitmap of the hashed ids is broadcast to the scan. It is a filter with a proven
    size, so that most rows need no exchange; whoever uses it joins the rest on the id.
    """
    bitmaps = ids.groupBy(F.bitmap_bucket_number(_filter_place("doc_id")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_filter_place("doc_id"))).alias("_bitmap")
    )
    at = F.bitmap_bit_position(_filter_place(id_col))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")
    there = F.pmod(byte.cast("int"), bit * 2) >= bit
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(_filter_place(id_col)))
        .join(F.broadcast(bitmaps), "_bucket", "left")
        .withColumn("_maybe", F.coalesce(there, F.lit(False)))
        .drop("_bucket", "_bitmap")
    )


def without(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids.doc_id``; only rows in doubt are exchanged."""
    held = marked(rows, ids, id_col)
    doubtful = held.where("_maybe").drop("_maybe")
    gone = ids.select(F.col("doc_id").alias("_gone"))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone"))
    return held.where(~F.col("_maybe")).drop("_maybe").unionByName(doubtful.join(gone, same, "left_anti"))


def crc_of(column: str) -> Column:
    """crc32 of the decimal text of an id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Rows of a file that ``numbered`` sorts together where it keeps their places: 2 to this power.
PLACES = 12


def with_place(docs: DataFrame, alias: str = "_place") -> DataFrame:
    """``docs`` with the place of each row: file after file, by the numbers Spark gave them when
    it wrote the rows, and row after row. Rows of no file follow their partitions."""
    if docs.inputFiles():
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
        place = F.shiftleft(F.coalesce(part, F.lit(0)), 33) + F.col("_metadata.row_index")
        try:
            return docs.withColumn(alias, place)
        except AnalysisException:
            pass  # read from files, but through other operators
    return docs.withColumn(alias, F.monotonically_increasing_id())


def numbered(
    df: DataFrame, group: list[str], order: list[str], alias: str, salts: int = 4096, places: bool = False
):
    """Row numbers from 0 within ``group`` by (salt, ``order``), whatever a group's size.

    ``order`` begins with the id that is hashed to a salt. Rows are counted per
    group and salt, the counts are summed up to offsets, and only the rows of one
    salt are ever sorted together. With ``places`` it begins with a place as of
    ``with_place``, whose stretches are the salts, so that numbers follow the places.
    """
    if places:
        salt = F.shiftright(F.col(order[0]), PLACES)
    else:
        salt = F.pmod(F.xxhash64(F.col(order[0])), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
    held = salted.withColumn("_local", local - 1)
    names = [*group, "_salt"]
    joined = held.alias("l").join(
        offsets.select(*[F.col(c).alias(f"_o_{c}") for c in names], "_before"),
        on=[F.col(f"l.{c}").eqNullSafe(F.col(f"_o_{c}")) for c in names],
    )
    return joined.withColumn(alias, (F.col("_local") + F.col("_before")).cast("bigint")).drop(
        "_salt", "_local", "_before", *[f"_o_{c}" for c in names]
    )
