"""Csv and xml extracts, channel documents and the sync log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roomledger.operators.channels import (
    ARI_ROOT,
    EXPORT_ATTRIBUTES,
    EXPORT_ROOT,
    channel_export_rooms,
    channel_export_xml,
    channel_payload_xml,
    hotel_of,
)
from roomledger.plans.stored import replaced
from roomledger.sources.schema import schema_of
from roomledger.sources.tables import Tables


CSV_TIME = "yyyy-MM-dd HH:mm:ss"


class NoData(ValueError):
    """An extract that has no rows."""


def write_csv(df: DataFrame, path: str) -> int:
    """Csv with a header; returns the number of rows, raises ``NoData`` for none.

    An extract without rows is refused before anything is written, so the one
    stored before it stays; so it does when the write fails (``replaced``). Rows
    are counted while they are written. Values that hold a comma, a quote or a line break are quoted, quotes doubled,
    nulls empty.
    """
    if df.isEmpty():
        raise NoData(f"no rows for {path}")
    seen = Observation("csv")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.options(
        header="true",
        quote='"',
        escape='"',
        nullValue="",
        emptyValue="",
        timestampFormat=CSV_TIME,
        timestampNTZFormat=CSV_TIME,
    )
    replaced(df.sparkSession, path, writer.csv)
    return seen.get["rows"]


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a written extract, ``line``; the header, which begins every part, comes once."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("part"), F.monotonically_increasing_id().alias("at")
    )
    first = lines.groupBy("part").agg(F.min("at").alias("at"), F.min_by("line", "at").alias("line"))
    body = lines.join(first.select("part", "at"), ["part", "at"], "left_anti").select("line")
    return first.select("line").limit(1).unionByName(body)


def write_channel_xml(t: Tables, today: dt.date, channel_id: int, path: str) -> None:
    """Room elements under the export root, one per active room.

    Files hold rooms, not one hotel-wide list, so each is a document of its
    own and they are written in parallel; the hotel id rides on every room.
    """
    rooms = channel_export_rooms(t, today).withColumn("hotel_id", hotel_of(t, channel_id))
    writer = rooms.write.format("xml").options(
        rowTag="room", rootTag=f'{EXPORT_ROOT} version="1.0"'
    )
    replaced(rooms.sparkSession, path, writer.save)


def _escaped(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _write_document(head: Column, elements: DataFrame, tail: str, path: str) -> None:
    """``head``, the (room_id, value) elements in order, and ``tail`` as text.

    The part files, joined in the order of their names, are one document; no
    task ever holds more than its own range of rooms.
    """
    frame = elements.sparkSession.range(1)

    def edge(part: int, value: Column) -> DataFrame:
        return frame.select(
            F.lit(part).alias("part"), F.lit(0).alias("room_id"), value.alias("value")
        )

    body = elements.select(F.lit(1).alias("part"), "room_id", "value")
    lines = edge(0, head).unionByName(body).unionByName(edge(2, F.lit(tail)))
    ordered = lines.orderBy("part", "room_id").select("value")
    replaced(elements.sparkSession, path, ordered.write.text)


def write_hotel_xml(
    t: Tables, today: dt.date, channel_id: int, hotel_name: str, path: str
) -> None:
    """The export of a hotel with its rooms nested in it, as ordered parts."""
    head = F.concat(
        F.lit(f'<{EXPORT_ROOT} {EXPORT_ATTRIBUTES}><hotel id="'),
        _escaped(hotel_of(t, channel_id)),
        F.lit('"><name>'),
        _escaped(F.lit(hotel_name)),
        F.lit("</name><rooms>"),
    )
    rooms = channel_export_xml(t, today).withColumnRenamed("element", "value")
    _write_document(head, rooms, f"</rooms></hotel></{EXPORT_ROOT}>", path)


def write_ari_xml(t: Tables, today: dt.date, channel_id: int, path: str) -> None:
    """The rate-and-availability message of a hotel, as ordered parts.

    Credentials are never loaded; whoever delivers the message adds them.
    """
    head = F.concat(
        F.lit(f"<{ARI_ROOT}><hotel_id>"), _escaped(hotel_of(t, channel_id)), F.lit("</hotel_id>")
    )
    rooms = channel_payload_xml(t, today).withColumnRenamed("payload", "value")
    _write_document(head, rooms, f"</{ARI_ROOT}>", path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Channel documents, one json text per line."""
    lines = documents.select(F.col("payload").alias("value"))
    replaced(lines.sparkSession, path, lines.write.text)


def append_sync_log(log_rows: DataFrame, path: str) -> None:
    """Adds the rows of a sync run to the stored log, in its declared columns and types."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of("ota_sync_logs").fields]
    log_rows.select(*typed).write.mode("append").parquet(path)
