"""Row numbers from stored ranges against plain sorting, and the plan of the guest upsert."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from roomledger.operators.changes import upsert_customers
from roomledger.plans.numbering import number_rows, number_within, positions
from roomledger.sources.starmap import StarSource
from tests.conftest import STAR, rows_of
from tests.test_rows_kept import AS_OF


def test_two_thousand_ranges_of_sparse_ids(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(1 << 60) for _ in range(3000)})
    df = spark.createDataFrame([(i, i % 3) for i in rng.sample(ids, len(ids))], "id bigint, g int")
    numbered = number_rows(df, F.col("id"), "n", ranges=2000)
    assert sorted(rows_of(numbered, "n", "id")) == list(enumerate(ids, 1))
    plan = numbered._jdf.queryExecution().toString()
    assert "map(" not in plan and "Window" not in plan and "SinglePartition" not in plan


def test_nearly_all_keys_null(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 1000 == 1, -F.col("id")))
    got = dict(rows_of(number_rows(df, F.col("k"), "n"), "id", "n"))
    assert {i: n for i, n in got.items() if n} == {4001: 1, 3001: 2, 2001: 3, 1001: 4, 1: 5}
    assert len(got) == 5000


def test_equal_rows_null_groups_and_no_rows(spark):
    rows = [(1, 5), (1, 5), (None, 7), (None, 6), (None, None)] + [(2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id bigint")
    got = sorted(rows_of(number_within(df, "g", "id", "n"), "g", "id", "n"), key=repr)
    plain = sorted([(1, 5, 1), (1, 5, 2), (None, None, 1), (None, 6, 2), (None, 7, 3)] + [(2, i, i + 1) for i in range(300)], key=repr)
    assert got == plain
    assert number_within(df.limit(0), "g", "id", "n").count() == 0
    assert number_rows(df.limit(0), F.col("id"), "n").count() == 0
    falling = positions(df, [F.desc("id"), F.asc("g")], "n")
    assert rows_of(falling.where("n <= 2").orderBy("n"), "id") == [(299,), (298,)]


def test_upsert_meets_the_guests_once(spark, monkeypatch):
    """What is stored first holds the only join of both tables, one scan of each."""
    from roomledger.operators import changes

    plans = []

    def kept(df, what):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, what)

    stored = changes.stored
    monkeypatch.setattr(changes, "stored", kept)
    src = StarSource(spark, STAR)
    result = upsert_customers(src.incoming_customers(), src.customers(), AS_OF)
    assert len(plans) == 1 and plans[0].count("Join FullOuter") == 1
    assert "FullOuter" not in result._jdf.queryExecution().optimizedPlan().toString()
    added = [r[0] for r in rows_of(result.where("action = 'insert'").orderBy("id"), "id")]
    highest = src.customers().agg(F.max("id")).first()[0]
    assert added == list(range(highest + 1, highest + 1 + len(added)))
