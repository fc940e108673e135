"""The search index against the scan, and how much of it a search reads."""

from __future__ import annotations

import random

import pytest

from roomledger.operators import customers, search
from roomledger.sources.schema import schema_of
from tests.conftest import rows_of

NAMES = ["Ann", "ANNA", "Hannah", "Ünal", "İnan", "ΟΔΟΣ", "O'Neil", "100%", "a_b", "x\\y", "", None, "Lee", "  lee "]


@pytest.fixture(scope="module")
def guests(spark, tmp_path_factory):
    from roomledger.sources.tables import Tables

    rng = random.Random(1)
    rows = []
    for i in range(4000):
        given = {"id": i * 7 - 50, "first_name": rng.choice(NAMES), "last_name": rng.choice(NAMES),
                 "email": rng.choice([None, f"guest{i}@x{i % 9}.org"]), "phone": f"+49 {rng.randrange(10**7)}"}
        rows.append(tuple(given.get(f.name) for f in schema_of("customers").fields))
    held = spark.createDataFrame(rows, schema_of("customers"))
    none = spark.createDataFrame([], schema_of("bookings"))
    path = str(tmp_path_factory.mktemp("index") / "postings")
    search.write_search_index(held, path, files=16)
    return Tables(lambda name: held if name == "customers" else none), path


@pytest.mark.parametrize(
    "text",
    ["ann", "ANN", "nna", "an", "", "%", "100%", "a_b", "_nn", "x\\\\y", "ünal", "İNAN", "i̇nan", "ΟΔΟΣ", "οδοσ", "guest39",
     "@x3.org", "guest", "o'n", "lee", " lee", "e@x", "+49 12", "nobody", "annanna", "+49 1234567"],
)
def test_indexed_search_equals_the_scan(guests, text):
    t, path = guests
    if text:
        scanned = rows_of(customers.customer_search(t, text, limit=5000), "id")
        assert rows_of(customers.customer_search(t, text, limit=5000, index=path), "id") == scanned
    paged = rows_of(customers.customers_page(t, search=text, limit=5000), "id")
    assert rows_of(customers.customers_page(t, search=text, limit=5000, index=path), "id") == paged
    counts = [customers.customers_page_count(t, text, index=i).first() for i in (None, path)]
    assert counts[0] == counts[1]


def scanned_rows(df) -> int:
    """Rows that left the parquet scans of the plan that ran."""
    total = 0

    def walk(node):
        nonlocal total
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "parquet" in name:
            total += node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_a_search_reads_few_postings(spark, guests):
    t, path = guests
    every = spark.read.parquet(path).count()
    df = customers.customer_search(t, t.customers.first()["phone"][-6:], index=path)
    df.collect()
    assert "parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert 0 < scanned_rows(df) < every / 2
    assert search.grams_of(spark, "ab") is None and search.grams_of(spark, "a%c") is None
    assert search.grams_of(spark, "AbC d") == ["abc", "bc ", "c d"]


def test_postings_are_made_by_more_tasks_than_read_the_guests(spark, guests, monkeypatch):
    written = []
    monkeypatch.setattr(search, "write_clustered", lambda *given: written.append(given))
    search.write_search_index(guests[0].customers.coalesce(1), "nowhere")
    postings, _, _, files = written[0]
    assert postings.rdd.getNumPartitions() == files >= 4 * spark.sparkContext.defaultParallelism
