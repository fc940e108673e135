"""A write that fails leaves the extract that was there; tables come back as they were written."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from roomledger.operators import rooms
from roomledger.plans.stored import replaced
from roomledger.sinks import files
from roomledger.sources.tables import load_tables, store_tables, table_contents
from tests.conftest import rows_of
from tests.test_traps import room


def broken(spark, n=100):
    """Rows of which a late one fails."""
    late = F.when(F.col("id") == n - 1, F.raise_error(F.lit("late"))).otherwise(F.col("id"))
    return spark.range(n, numPartitions=4).select(late.cast("string").alias("payload"))


def test_failed_csv_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    assert files.write_csv(spark.range(3), path) == 3
    with pytest.raises(Exception, match="late"):
        files.write_csv(broken(spark), path)
    assert sorted(rows_of(files.csv_text(spark, path))) == [("0",), ("1",), ("2",), ("id",)]
    assert files.write_csv(spark.range(5), path) == 5
    assert files.csv_text(spark, path).count() == 6
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]


def test_failed_documents_leave_the_old_ones(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_documents(spark.sql("SELECT 'a' AS payload"), path)
    with pytest.raises(Exception, match="late"):
        files.write_documents(broken(spark), path)
    assert rows_of(spark.read.text(path)) == [("a",)]
    assert [p.name for p in tmp_path.iterdir()] == ["docs"]


def test_a_write_that_dies_halfway_is_cleaned_up(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.range(2).write.parquet(path)

    def dies(where):
        spark.range(9).write.parquet(where)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        replaced(spark, path, dies)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in pathlib.Path(tmp_path).iterdir()] == ["out"]


def test_a_row_that_looks_like_the_header_stays(spark, tmp_path):
    path = str(tmp_path / "odd")
    files.write_csv(spark.sql("SELECT * FROM VALUES ('x'), ('name'), ('name') AS t(name)").repartition(2), path)
    assert sorted(rows_of(files.csv_text(spark, path))) == [("name",)] * 3 + [("x",)]


def test_one_room_shows_all_its_images(make_tables):
    images = [dict(id=i, room_id=1, image_path=f"p{i}", display_order=i) for i in range(250)]
    t = make_tables(rooms=[room(1), room(2)], room_images=images)
    one = rooms.room_detail(t, room_id=1).first()
    assert [i["image_path"] for i in one["images"]] == [f"p{i}" for i in range(250)]
    each = {r["id"]: r for r in rooms.room_detail(t).collect()}
    assert len(each[1]["images"]) == rooms.IMAGES_SHOWN and each[1]["image_count"] == 250
    assert rooms.room_detail(t, room_id=2).first()["image_count"] == 0


def test_stored_tables_are_replaced_and_compared(spark, make_tables, tmp_path):
    t, path = make_tables(rooms=[room(1), room(2), room(2)]), str(tmp_path / "hotel")
    store_tables(make_tables(rooms=[room(7)]), path)
    store_tables(t, path)
    assert sorted(rows_of(table_contents(load_tables(spark, path)))) == sorted(rows_of(table_contents(t)))
    other = table_contents(make_tables(rooms=[room(1), room(2), room(3)]))
    assert sorted(rows_of(other)) != sorted(rows_of(table_contents(t)))
