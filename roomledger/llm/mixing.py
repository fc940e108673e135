"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hashed order, form blocks. Time is cut into slots, one block
each. Block ``i`` of a source of weight ``w`` is released at ``floor(i / w)`` and due at
``ceil((i + 1) / w)``; in every slot the released block with the earliest deadline goes
(ties: the heavier source, then the name). Weights are shares ``q / CYCLE`` and add up to
one, so every deadline is met, and at any time a source has had less than one block more
or less than its weight's part of the slots.

Such a schedule repeats every ``CYCLE`` slots, in which a source has exactly ``q``
blocks. Only one cycle is computed, a table of ``CYCLE`` rows; the slot of every block
follows by division, wherever the block is. Document counts per source are all that
reaches the driver.

Every document gets a slot. ``in_mix`` tells the slots before the first source runs
out, in which the target weights hold as stated; later slots keep the ratios of the
sources that remain.

Defined cases: a null source is a source of its own; repeated rows are scheduled each; a
null id is hashed like any value; sources of weight 0 never enter the mixture and get no
slot (null); an empty table gives no rows; other columns are not read by the schedule
and are kept by ``mixed``.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.llm.common import stored

CYCLE = 2048
BLOCK = 8
#: Weight of a source of n documents, if no weights are given: n to this power.
POWER = 0.7
ROWS_PER_BUCKET = 2000


def shares(sizes: dict[str, int], weights: dict[str, float] | None, cycle: int = CYCLE) -> dict[str, int]:
    """Slots of a cycle per source, at least one each: largest remainders, then names."""
    if weights is None:
        weights = {s: n**POWER for s, n in sizes.items()}
    wanted = {s: weights.get(s, 0.0) for s in sizes if weights.get(s, 0.0) > 0}
    if not wanted:
        return {}
    while cycle < 16 * len(wanted):
        cycle *= 2
    total, free = sum(wanted.values()), cycle - len(wanted)
    exact = {s: free * w / total for s, w in wanted.items()}
    found = {s: 1 + math.floor(x) for s, x in exact.items()}
    by_rest = sorted(wanted, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    for s in by_rest[: cycle - sum(found.values())]:
        found[s] += 1
    return found


def cycle_slots(found: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` of one cycle, earliest deadline first."""
    cycle = sum(found.values())
    waiting = [(0, s) for s in found]  # release of each source's next block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    done = dict.fromkeys(found, 0)
    rows = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * cycle // found[s]), -found[s], s))
        due, _, s = heapq.heappop(ready)
        rows.append((s, done[s], done[s] * cycle // found[s], due, slot))
        done[s] += 1
        if done[s] < found[s]:
            heapq.heappush(waiting, (done[s] * cycle // found[s], s))
    return rows


def _placed(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, place)``: places from 0 within a source, by md5 of the id.

    The first digits of the md5 cut a source, however large, into stretches that are
    numbered apart and shifted by the counts before them.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    ).withColumn("_digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return stored(rows, "mixing")


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
    cycle: int = CYCLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block, position (in the block), release,
    deadline, slot, in_mix."""
    spark = docs.sparkSession
    rows = _placed(docs, id_col, source_col)
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    found = shares(sizes, weights, cycle)
    length = max(1, sum(found.values()))
    digits = max(1, math.ceil(math.log(max(sizes.values(), default=1) / ROWS_PER_BUCKET + 1, 16)))
    cut = rows.withColumn("_part", F.substring("_digest", 1, digits))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("source", "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    within = Window.partitionBy("source", "_part").orderBy("_digest", "doc_id")
    placed = (
        cut.withColumn("_local", F.row_number().over(within) - 1)
        .join(offsets, ["source", "_part"])
        .withColumn("_place", F.col("_local") + F.col("_before"))
        .withColumn("block", F.floor(F.col("_place") / F.lit(block)))
        .withColumn("position", F.pmod("_place", F.lit(block)).cast("int"))
    )
    # one cycle: as many rows as the cycle has slots
    slots = cycle_slots(found)
    plan = spark.createDataFrame(
        slots, "source string, _in_cycle long, _release long, _due long, _slot long"
    )
    # the first slot whose block is missing
    at = {(s, b): slot for s, b, _, _, slot in slots}
    horizon = length * (max(sizes.values(), default=0) + 1)
    for s, share in found.items():
        cycles, rest = divmod(-(-sizes[s] // block), share)
        horizon = min(horizon, cycles * length + at[s, rest])
    part = spark.createDataFrame(
        [(s, found.get(s)) for s in sizes], "source string, _of long"
    )
    cycles = F.floor(F.col("block") / F.col("_of"))
    since = cycles * F.lit(length)
    return (
        placed.join(F.broadcast(part), "source")
        .withColumn("_in_cycle", F.pmod("block", F.col("_of")))
        .join(F.broadcast(plan), ["source", "_in_cycle"], "left")
        .select(
            "doc_id",
            "source",
            "block",
            "position",
            (since + F.col("_release")).alias("release"),
            (since + F.col("_due")).alias("deadline"),
            (since + F.col("_slot")).alias("slot"),
            F.coalesce(since + F.col("_slot") < F.lit(horizon), F.lit(False)).alias("in_mix"),
        )
    )


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
    whole: bool = False,
) -> DataFrame:
    """The rows of ``docs`` in the mixture, in schedule order within each of its partitions.

    Documents scheduled after the first source has run out are left out: from there on
    the target weights cannot be kept. With ``whole`` every row that has a slot stays, and
    later slots keep the ratios of the sources that remain. Rows that repeat an id in a
    source stay together, at the first of their places.
    """
    order = schedule(docs, weights, id_col, source_col, block)
    order = order.where("slot IS NOT NULL" if whole else "in_mix")
    chosen = order.groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source")).agg(
        F.min(F.struct("slot", "position")).alias("_mix_at")
    )
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_mix_id"))
    same &= F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col("_mix_source")
    placed = docs.join(chosen, same).orderBy("_mix_at.slot", "_mix_at.position")
    return placed.drop("_mix_id", "_mix_source", "_mix_at")
