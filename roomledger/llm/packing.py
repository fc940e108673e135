"""Packing documents into sequences of bounded length by bin completion.

How many pieces have which length is all that a packing depends on, and there are
at most ``capacity`` lengths. So the search runs on this histogram: a branch takes
the largest length left, enumerates the undominated fillings of the gap around it,
and applies one to as many sequences as the counts allow at once. A branch ends
where its waste exceeds what a solution better than the incumbent may waste; the
first incumbent is best-fit decreasing. The search stops at the volume bound or
after ``nodes`` branches and keeps the best solution found.

The solution is a table of stretches: ranks ``a`` to ``b`` of the pieces of one
length go to consecutive sequences at a fixed offset. It has at most a few
thousand rows whatever the corpus, and meets the ranked pieces in a broadcast join.

Defined cases: null text is empty and yields one piece, the end id alone; repeated
rows are packed each; a null id is kept; an empty table gives no rows; other
columns are not read. Ties between pieces of one length are broken by salted id.
"""

from __future__ import annotations

import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import documents, numbered, stored, with_place, worker_cache
from roomledger.llm.tokens import WordIds
from roomledger.plans.numbering import positions

CAPACITY = 2048
NODES = 4000
END_ID = 0
ROWS_AT_ONCE = 2500

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _place long"
_PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("ids", pa.binary()), ("_place", pa.int64())]
)


@worker_cache
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def _cut(path: str, capacity: int, with_ids: bool, batches):
    end = END_ID.to_bytes(4, "little")
    encode = _encoder(path)
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            out: list[list] = [[], [], [], [], [], [], []]
            places = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
            for doc_id, ids, place in zip(part.column(0).to_pylist(), encode(part.column(1)), places):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    held = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(held) // 4, zlib.crc32(held))
                    kept = _narrow(held) if with_ids else None
                    for column, value in zip(out, (*row, kept, place)):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, _PIECES_ARROW.types)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PIECES_ARROW)


def _narrow(ids: bytes) -> bytes:
    """Two bytes per id where they suffice, for the way through the exchange; a first byte
    tells which it is."""
    held = np.frombuffer(ids, "<u4")
    return b"\2" + held.astype("<u2").tobytes() if held.max(initial=0) < 1 << 16 else b"\4" + ids


def _widened(batches):
    for batch in batches:
        place = batch.schema.get_field_index("ids")
        wide = [
            np.frombuffer(x[1:], f"<u{x[0]}").astype("<u4").tobytes()
            for x in batch.column(place).to_pylist()
        ]
        yield batch.set_column(place, "ids", pa.array(wide, pa.binary()))


Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, all equal sequences at once: ``(filling, sequences)``."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, bins: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((filling, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                bins = left // each
                put(capacity - each * length, ((length, each),), bins)
                left -= each * bins
                continue
            room = rooms[at]
            filling, bins = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left)
            used = min(bins, left // each)
            if used < bins:
                put(room, filling, bins - used)
            put(room - each * length, (*filling, (length, each)), used)
            left -= each * used
    return [found for room in rooms for found in open_[room]]


def _dominated(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` fit into the items of ``large``, taken as rooms."""
    if not small:
        return True
    for i, room in enumerate(large):
        if small[0] <= room and _dominated(
            small[1:], tuple(sorted((*large[:i], *large[i + 1 :], room - small[0]), reverse=True))
        ):
            return True
    return False


def fillings(counts: np.ndarray, gap: int, width: int = 24, most: int = 6) -> list[tuple[int, ...]]:
    """Undominated sets of lengths for a gap, fullest first.

    Up to two items are enumerated, ``width`` lengths deep each, and the rest of
    the gap is closed with the largest lengths that fit.
    """
    there = np.flatnonzero(counts[: gap + 1])
    if not len(there):
        return [()]

    def below(room: int, used: list[int]) -> int:
        at = int(np.searchsorted(there, room, "right")) - 1
        while at >= 0 and counts[there[at]] <= used.count(int(there[at])):
            at -= 1
        return at

    def closed(items: list[int]) -> tuple[int, ...]:
        room = gap - sum(items)
        while (at := below(room, items)) >= 0:
            items.append(int(there[at]))
            room -= items[-1]
        return tuple(sorted(items, reverse=True))

    found = set()
    first = below(gap, [])
    for i in range(first, max(-1, first - width), -1):
        a = int(there[i])
        found.add(closed([a]))
        second = below(min(a, gap - a), [a])
        for j in range(second, max(-1, second - width), -1):
            b = int(there[j])
            if counts[b] > (a == b):
                found.add(closed([a, b]))
        if any(sum(f) == gap for f in found) and len(found) >= 4 * most:
            break
    ordered = sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))[: 4 * most]
    kept: list[tuple[int, ...]] = []
    for f in ordered:
        if len(f) > 4 or not any(len(g) <= 4 and g != f and _dominated(f, g) for g in kept):
            kept.append(f)
    return kept[:most]


def complete_bins(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES
) -> list[tuple[Filling, int]]:
    """``(filling, sequences)`` that hold every piece of the histogram."""
    counts = {length: n for length, n in counts.items() if n}
    total = sum(length * n for length, n in counts.items())
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), -(-total // capacity)
    start = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        start[length] = n
    # (counts left, waste so far, chain of (filling, sequences, chain before))
    stack: list[tuple[np.ndarray, int, tuple | None, int]] = [(start, 0, None, 0)]
    while stack and nodes and fewest > bound:
        nodes -= 1
        left, waste, chain, bins = stack.pop()
        there = np.flatnonzero(left)
        if not len(there):
            if bins < fewest:
                fewest, best = bins, []
                while chain:
                    filling, n, chain = chain
                    best.append((filling, n))
            continue
        allowed = (fewest - 1) * capacity - total
        if waste > allowed:
            continue
        largest = int(there[-1])
        rest = left.copy()
        rest[largest] -= 1
        for items in reversed(fillings(rest, capacity - largest)):
            lengths, copies = np.unique((largest, *items), return_counts=True)
            each = capacity - int((lengths * copies).sum())
            times = int((left[lengths] // copies).min())
            if each and times * each > allowed - waste:
                times = (allowed - waste) // each
            if times < 1:
                continue
            after = left.copy()
            after[lengths] -= copies * times
            filling = tuple((int(a), int(c)) for a, c in zip(lengths[::-1], copies[::-1]))
            stack.append((after, waste + each * times, (filling, times, chain), bins + times))
    return best


def stretches(plan: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, copies, first sequence, offset)`` of a plan."""
    rows, ranks, sequence = [], {}, 0
    for filling, bins in plan:
        offset = 0
        for length, copies in filling:
            first = ranks.get(length, 0)
            ranks[length] = first + copies * bins
            rows.append((length, first, ranks[length], copies, sequence, offset))
            offset += copies * length
        sequence += bins
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
    nodes: int = NODES,
    in_order: bool = False,
) -> DataFrame:
    """One row per piece: its place in its document, its sequence and its offset there.

    ``with_ids`` adds the ids as little-endian 32-bit integers. ``in_order`` keeps to the
    order of the rows of ``docs`` as far as as few sequences allow: of pieces of one length
    the earlier ones go to the earlier sequences of a filling, and sequences are numbered
    from 0 by the first of their documents.
    """
    docs = with_place(docs) if in_order else docs
    more = ["_place"] if in_order else []
    unused = [c for c, used in (("ids", with_ids), ("_place", in_order)) if not used]
    cut = documents(docs, id_col, text_col, *more).mapInArrow(
        functools.partial(_cut, tokenizer, capacity, with_ids), PIECES
    )
    pieces = stored(cut.drop(*unused), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = docs.sparkSession.createDataFrame(
        stretches(complete_bins(counts, capacity, nodes)),
        "_length long, _from long, _to long, _copies long, _sequence long, _offset long",
    )
    placed = _in_rows(pieces, places) if in_order else _placed(
        numbered(pieces, ["length"], ["doc_id", "piece"], "_rank"), places
    )
    return placed.mapInArrow(_widened, placed.schema) if with_ids else placed


def _placed(ranked: DataFrame, places: DataFrame) -> DataFrame:
    since = F.col("_rank") - F.col("_from")
    return (
        ranked.join(
            F.broadcast(places),
            (F.col("length") == F.col("_length"))
            & (F.col("_rank") >= F.col("_from"))
            & (F.col("_rank") < F.col("_to")),
        )
        .withColumn("sequence_id", (F.col("_sequence") + F.floor(since / F.col("_copies"))).cast("bigint"))
        .withColumn("offset", F.col("_offset") + F.pmod(since, F.col("_copies")) * F.col("length"))
        .drop("_rank", *places.columns)
    )


def _in_rows(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The pieces dealt out by their places. Only lengths and places are ranked; the ids
    join the result once."""
    narrow = pieces.select("_place", "piece", "length")
    ranked = numbered(narrow, ["length"], ["_place", "piece"], "_rank", places=True)
    dealt = stored(_placed(ranked, places).drop("length"), "dealt")
    firsts = dealt.groupBy("sequence_id").agg(F.min(F.struct("_place", "piece")).alias("_first"))
    order = positions(firsts, [F.col("_first")], "_number").select("sequence_id", (F.col("_number") - 1).alias("_number"))
    renumbered = dealt.join(order, "sequence_id").select("_place", "piece", F.col("_number").alias("sequence_id"), "offset")
    return pieces.join(renumbered, ["_place", "piece"]).select(
        *[c for c in pieces.columns if c != "_place"], "sequence_id", "offset"
    )
