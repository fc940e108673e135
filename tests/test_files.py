from __future__ import annotations

import datetime as dt
import glob
import json
from xml.etree import ElementTree

import pytest

from roomledger.operators import channels
from roomledger.operators.exports import export_bookings
from roomledger.sinks import files
from roomledger.sources.schema import TABLE_NAMES, schema_of
from roomledger.sources.seed import seed_dims
from roomledger.sources.tables import Tables, jdbc_options, load_tables, table_sizes
from tests.conftest import rows_of
from tests.test_traps import guest, room, stay

TODAY = dt.date(2024, 6, 15)
NOON = dt.datetime(2024, 6, 15, 12)


@pytest.fixture
def hotel(make_tables):
    return make_tables(
        room_categories=[dict(id=1, name="Suite")],
        rooms=[
            room(1, room_category_id=1, room_name='A & "B"'),
            room(2),
            room(3, is_active=False),
        ],
        bookings=[stay(1, 1, "2024-06-14", "2024-06-16")],
        customers=[guest(1)],
        ota_configurations=[
            dict(id=1, ota_name="Booking.com", hotel_id='H"1', is_active=True),
            dict(id=2, ota_name="Agoda", hotel_id="H2", is_active=True),
            dict(id=3, ota_name="Airbnb", hotel_id="H3", is_active=True),
            dict(id=4, ota_name="Other", hotel_id="H4", is_active=True),
            dict(id=5, ota_name="agoda", hotel_id="H5", is_active=False),
        ],
    )


def test_csv_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame(
        [("a,b", 'say "x"', None, dt.date(2024, 6, 1)), ("plain", "two\nlines", 2, None)],
        "one string, two string, n int, d date",
    )
    assert files.write_csv(df.coalesce(1), str(tmp_path / "out")) == 2
    (part,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    assert open(part).read() == (
        'one,two,n,d\n"a,b","say ""x""",,2024-06-01\nplain,"two\nlines",2,\n'
    )
    back = spark.read.csv(
        str(tmp_path / "out"), header=True, multiLine=True, escape='"', schema=df.schema
    )
    assert sorted(rows_of(back), key=str) == sorted(rows_of(df), key=str)
    assert rows_of(files.csv_text(spark, str(tmp_path / "out")))[0] == ("one,two,n,d",)


def test_an_empty_extract_is_an_error(hotel, tmp_path):
    none = export_bookings(hotel).where("adults > 99")
    with pytest.raises(files.NoData):
        files.write_csv(none, str(tmp_path / "none"))
    # The extract stored before stays.
    held = str(tmp_path / "held")
    rows = files.write_csv(export_bookings(hotel), held)
    with pytest.raises(files.NoData):
        files.write_csv(none, held)
    assert none.sparkSession.read.csv(held, header=True).count() == rows > 0


def _joined(path: str) -> str:
    return "".join(open(p).read() for p in sorted(glob.glob(path + "/part-*")))


def test_hotel_xml_reads_back(spark, hotel, tmp_path):
    files.write_hotel_xml(hotel, TODAY, 1, "Sea & Sun", str(tmp_path / "hotel"))
    text = _joined(str(tmp_path / "hotel"))
    assert ElementTree.fromstring(text).tag == "ota_export"
    (tmp_path / "one.xml").write_text(text)
    back = spark.read.format("xml").options(rowTag="hotel").load(str(tmp_path / "one.xml")).first()
    assert (back["_id"], back["name"]) == ('H"1', "Sea & Sun")
    got = [(r["_id"], r["name"], r["category"], r["availability"]) for r in back["rooms"]["room"]]
    assert got == [(1, 'A & "B"', "Suite", "unavailable"), (2, "Room 2", None, "available")]


def test_ari_message_lists_the_rooms_in_order(hotel, tmp_path):
    files.write_ari_xml(hotel, TODAY, 1, str(tmp_path / "ari"))
    root = ElementTree.fromstring(_joined(str(tmp_path / "ari")))
    assert root.tag == "ari_update" and root.findtext("hotel_id") == 'H"1'
    got = [
        (r.findtext("room_id"), r.findtext("availability"), r.findtext("restrictions/max_stay"))
        for r in root.findall("rooms")
    ]
    assert got == [("1", "0", "30"), ("2", "1", "30")]


def test_room_xml_is_written_in_parallel_files(spark, hotel, tmp_path):
    path = str(tmp_path / "rooms")
    files.write_channel_xml(hotel, TODAY, 1, path)
    back = spark.read.format("xml").options(rowTag="room").load(path)
    assert sorted(rows_of(back, "_id", "hotel_id", "capacity")) == [(1, 'H"1', 2), (2, 'H"1', 2)]


def test_json_documents(spark, hotel, tmp_path):
    documents = channels.channel_payload_rates_json(hotel, 2, NOON, size=2)
    files.write_documents(documents, str(tmp_path / "rates"))
    found = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "rates")).collect()]
    assert {d["HotelId"] for d in found} == {"H2"}
    by_room = {r["RoomId"]: r for d in found for r in d["Rooms"]}
    assert by_room[1]["Rates"] == [
        {
            "RatePlan": "Standard",
            "Rate": 100.0,
            "Date": "2024-06-15",
            "Availability": 0,
            "Inventory": 1,
        }
    ]
    assert sorted(by_room) == [1, 2] and len(found) == 2
    (ops,) = channels.channel_payload_ops_json(hotel, 3, NOON).collect()
    assert json.loads(ops["payload"])["operations"][1] == {
        "room_id": "2",
        "availability": True,
        "price": {"amount": 100.0, "currency": "USD"},
        "date": "2024-06-15",
        "minimum_nights": 1,
    }
    # The xml form of the same rooms.
    elements = dict(rows_of(channels.channel_payload_xml(hotel, TODAY)))
    assert "<availability>0</availability>" in elements[1]
    assert "<name>" not in elements[1] and "A &amp; " in elements[1]


def test_sync_results_are_logged_and_move_the_clock(spark, hotel, tmp_path):
    calls = spark.createDataFrame(
        [
            (i, i, i != 2, dt.datetime(2024, 6, 15, 9) if i > 1 else None, dt.datetime(2024, 6, 15, 10, i))
            for i in range(1, 6)
        ],
        "delivery_id bigint, ota_configuration_id bigint, delivered boolean, "
        "started_at timestamp_ntz, completed_at timestamp_ntz",
    )
    results = channels.sync_log_rows(hotel, calls)
    names = ("ota_configuration_id", "status", "records_processed")
    assert sorted(rows_of(results, *names)) == [
        (1, "success", 2),
        (2, "failed", 2),
        (3, "success", 2),
        (4, "failed", 0),
    ]
    assert rows_of(channels.sync_run_summary(results)) == [(4, 2, 2)]
    moved = dict(rows_of(channels.last_syncs(hotel, results), "id", "last_sync_at"))
    assert [moved[i] is not None for i in range(1, 6)] == [True, True, True, False, False]
    log = str(tmp_path / "log")
    files.append_sync_log(results, log)
    files.append_sync_log(results, log)
    assert spark.read.parquet(log).count() == 8
    # The stored log has the declared types and is read by every log operator.
    stored = spark.read.schema(schema_of("ota_sync_logs")).parquet(log)
    kept = Tables(lambda name: stored if name == "ota_sync_logs" else getattr(hotel, name))
    day = dt.datetime(2024, 6, 15, 12)
    assert stored.where("sync_started_at IS NULL OR records_processed IS NULL").count() == 0
    assert sorted(r[1] for r in rows_of(channels.failed_syncs(kept, day))) == [2, 2]
    assert channels.sync_logs(kept).count() == 8
    assert sum(r[0] for r in rows_of(channels.sync_stats(kept, day), "total_syncs")) == 8
    assert sum(r[0] for r in rows_of(channels.sync_health(kept.ota_sync_logs), "total_syncs")) == 8
    assert "api_key" not in hotel.ota_configurations.columns


def test_tables_load_with_declared_types_and_without_secrets(spark, tmp_path):
    seeds = seed_dims(spark)
    for name in TABLE_NAMES:
        df = seeds.get(name)
        if df is None:
            df = spark.createDataFrame([], schema_of(name))
        if name == "users":
            df = df.selectExpr("*", "'x' AS password_hash")
        df.write.parquet(str(tmp_path / name))
    t = load_tables(spark, str(tmp_path))
    sizes = {k: n for k, n in rows_of(table_sizes(t)) if n}
    assert sizes == {
        "room_categories": 5,
        "amenities": 10,
        "currencies": 4,
        "languages": 4,
        "settings": 9,
    }
    assert t.users.schema == schema_of("users")
    assert rows_of(t.currencies.where("is_default"), "code", "is_active") == [("USD", True)]


def test_live_tables_are_read_by_id_ranges():
    options = jdbc_options("users", "jdbc:mysql://db/hotel", 1, 1000, 16)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "16"
    assert "password_hash" not in options["dbtable"]
    pairs = jdbc_options("room_amenities", "jdbc:mysql://db/hotel", 1, 1000, 4)
    assert pairs["partitionColumn"] == "room_id"
