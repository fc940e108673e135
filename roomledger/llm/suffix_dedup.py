"""Removal of byte strings that occur more than once, by suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. To find
these strings, suffixes are sorted by the difference-cover algorithm: the triples at two of
three positions are sorted and named, the string of names is sorted by recursion, the
remaining suffixes are sorted by their first character and the rank that follows, both are
merged, and the prefixes of neighbours are compared.

The suffixes are dealt out so that equal strings meet. Every string of ``length`` bytes has
a core: among the shorter strings in it, the one with the least hash. Neighbouring strings
with the same core share a stretch of text. A core at one place of the whole corpus belongs
to strings that occur once; nothing else of these is looked at. Equal stretches fold to one,
which knows that it occurs more than once, and leaves the block of documents that holds it
first. All strings of a stretch that occurs more than once repeat: its blocks are told so at
once, and a core with no other stretches is not sorted. The different stretches of the other
cores go to one task, many cores to each, and are sorted there; the runs of strings found
twice return to the blocks. Neither a copied document nor a passage in a third of all rows
puts more rows into a task than there are blocks or different stretches. A core with very
many different stretches is no task of its own: its strings are counted one by one instead.

Rows between the steps say where in the block a stretch begins, so that each text is hashed
once.

Defined cases: null and empty texts have nothing to remove; repeated rows are documents of
their own, so all of their strings repeat; null ids are kept; documents shorter than
``length`` stay whole; an empty table gives no rows; other columns are not read. What is
left of a text need not be whole characters and is therefore binary.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ship, stored

LENGTH = 200
#: Bytes of text in a block of documents, and of stretches in a task that sorts suffixes.
BLOCK_BYTES = 2 << 20
SORTED_BYTES = 2 << 20
#: Strings of a stretch, and stretches of a core that are still sorted in one task.
STRETCH = 512
STRETCHES = 8192
#: Positions that are hashed at a time, few enough for their arrays to stay in a core's cache.
HASHED = 1 << 15

# ``again``: runs of strings that recur within the block, as pairs of 32 bits; ``starts`` is the
# number of strings of a stretch, ``n`` how often it occurs in the block, 2 at most
_BLOCKS = (
    "block long, ids array<long>, sizes array<long>, packed binary, again binary, "
    "runs array<struct<core:long,stretch:long,begin:int,starts:int,n:int,again:boolean>>"
)
_RUN = [
    ("core", pa.int64()), ("stretch", pa.int64()), ("begin", pa.int32()), ("starts", pa.int32()), ("n", pa.int32()),
    ("again", pa.bool_()),
]
_BLOCKS_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary()),
        ("again", pa.binary()), ("runs", pa.list_(pa.struct(_RUN))),
    ]
)
_MET = "core long, block long, begin int, starts int, twice boolean, sent boolean, told boolean"
_SENT = "core long, block long, begin int, twice boolean, text binary"
_TEXTS = pa.schema(
    [("core", pa.int64()), ("block", pa.int64()), ("begin", pa.int32()), ("twice", pa.bool_()), ("text", pa.binary())]
)
_FOUND = "block long, begin int, end int"
_FOUND_ARROW = pa.schema([("block", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])
_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
_SPAN = [("begin", pa.int64()), ("end", pa.int64())]
_RESULT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct(_SPAN))), ("kept", pa.binary()),
    ]
)

# Cores and stretches ----------------------------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    tables = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def _hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each position, from sums of byte times power."""
    up, down = _powers(1 << max(16, int(len(text)).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(text * up[: len(text)], out=sums[1:])
    found = (sums[size:] - sums[:-size]) * down[: len(text) - size + 1]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima of twice as many neighbours each time."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _cores(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the core of the strings of ``length`` bytes changes, the cores from there on, and
    the cores that are met at more than one place: their strings may repeat inside one stretch."""
    core = max(1, length // 5)
    width = length - core + 1
    strings = len(text) - length + 1
    at, values, places = [], [], []
    last = None
    for a in range(0, len(text) - core + 1, HASHED):
        # places a to b; a place is a core's if its hash is the largest core of the strings around it
        b = min(a + HASHED, len(text) - core + 1)
        low, high = max(0, a - width + 1), min(b, strings)
        hashes = _hashes(text[low : min(b + width - 1, len(text) - core + 1) + core - 1], core)
        cores = _least(hashes, width)[: high - low]
        around = np.full(b - a + width - 1, np.iinfo(np.uint64).max, np.uint64)
        begin = low - (a - width + 1)
        around[begin : begin + len(cores)] = ~cores
        here = hashes[a - low : b - low]
        places.append(here[~_least(around, width) == here])
        cores = cores[a - low :]
        if len(cores):
            new = np.ones(len(cores), bool)
            new[1:] = cores[1:] != cores[:-1]
            new[0] = last is None or cores[0] != last
            last = cores[-1]
            at.append(np.flatnonzero(new) + a)
            values.append(cores[new])
    met, times = np.unique(np.concatenate(places), return_counts=True)
    return np.concatenate(at), np.concatenate(values).view(np.int64), met[times > 1].view(np.int64)


def runs_of(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and core of the runs of positions at which a string of one document starts
    and whose strings have the same core, at most ``STRETCH`` positions each, and the cores
    that are met at more than one place."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    long = sizes >= length
    if not long.any():
        return none, none, none, none
    first, stop = (ends - sizes)[long], (ends - length + 1)[long]
    at, values, again = _cores(text, length)
    begin = np.unique(np.concatenate((at, first, stop)))
    owner = np.searchsorted(first, begin, "right") - 1
    inside = (owner >= 0) & (begin < stop[owner])
    end = np.append(begin[1:], len(text))[inside]
    begin = begin[inside]
    core = values[np.searchsorted(at, begin, "right") - 1]
    pieces = -(-(end - begin) // STRETCH)
    if pieces.max() > 1:
        owner = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = begin[owner] + nth * STRETCH, np.minimum(begin[owner] + (nth + 1) * STRETCH, end[owner])
        core = core[owner]
    return begin, end, core, again


def _stretch(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=8).digest()


def _block(length: int, number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin, end, core, again = runs_of(np.frombuffer(whole, np.uint8), sizes, length)
    digests = [_stretch(whole[b:e]) for b, e in zip(begin.tolist(), (end + length - 1).tolist())]
    stretch = np.frombuffer(b"".join(digests), "<i8")
    order = np.lexsort((begin, stretch, core))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(core[order]) != 0) | (np.diff(stretch[order]) != 0)
    firsts = order[new]
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    twice = np.sort(order[np.repeat(n, n) > 1])
    recur = np.stack((begin[twice], end[twice]), axis=1).astype("<i4").tobytes()
    columns = [core, stretch, begin, end - begin]
    runs = [c[firsts] for c in columns] + [np.minimum(n, 2), np.isin(core[firsts], again)]
    held = pa.StructArray.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(runs, _RUN)], [name for name, _ in _RUN])
    packed = zstandard.ZstdCompressor(level=3).compress(whole)
    columns = [[number], [ids], [sizes.tolist()], [packed], [recur]]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _BLOCKS_ARROW)]
    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held))
    return pa.RecordBatch.from_arrays(arrays, schema=_BLOCKS_ARROW)


def _blocks(length: int, most: int, batches):
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_buffer().to_pybytes())
            size += len(texts[-1]) + 64
            if size >= most:
                yield _block(length, number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield _block(length, number, ids, texts)


def _whole(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _met(batches):
    """Rows of the cores that occur more than once, from rows sorted by core and stretch.

    The rows of the last core wait for the next batch.
    """
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [c[cut:] for c in rows]
        yield from _repeated([c[:cut] for c in rows])
    if held is not None:
        yield from _repeated(held)


def _repeated(rows: list[np.ndarray]):
    """Rows of whole cores: the stretches that are sent to be sorted (``sent``) and the blocks
    that are told that all strings of a stretch repeat (``told``)."""
    core, stretch, begin, starts, n, again, block = rows
    if not len(core):
        return
    new = np.ones(len(core), bool)
    new[1:] = core[1:] != core[:-1]
    first = new.copy()
    first[1:] |= stretch[1:] != stretch[:-1]

    def totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(starts)
        return np.repeat(np.add.reduceat(values.astype(np.int64), at), np.diff(np.append(at, len(values))))

    twice = totals(n, first) > 1
    # a stretch that occurs once is compared with the others of its core and, where the core
    # is met again in it, with itself
    asked = (totals(~twice, new) > 0) & ((totals(first, new) > 1) | (totals(again, new) > 0))
    sent = first & asked
    told = twice & (n == 1)
    keep = sent | told
    columns = [core, block, begin, starts, twice, sent, told]
    arrays = [pa.array(c[keep]) for c in columns]
    yield pa.RecordBatch.from_arrays(arrays, ["core", "block", "begin", "starts", "twice", "sent", "told"])


def _texts(length: int, blocks: pa.Table, sent: pa.Table) -> pa.Table:
    """Texts of the stretches that a block sends."""
    if not len(sent) or not len(blocks):
        return _TEXTS.empty_table()
    whole = _whole(blocks["packed"][0].as_py())
    begin, starts = (sent[c].to_numpy() for c in ("begin", "starts"))
    texts = [whole[b:e] for b, e in zip(begin.tolist(), (begin + starts + length - 1).tolist())]
    return pa.table([*(sent[c] for c in _TEXTS.names[:-1]), pa.array(texts, pa.binary())], schema=_TEXTS)


# Suffix sorting ------------------------------------------------------------------


def _paired(a: np.ndarray, b: np.ndarray, b_size: int) -> np.ndarray:
    """One number per pair, in the order of the pairs; ``b`` is below ``b_size``."""
    if (int(a.max(initial=0)) + 1) * b_size >= 1 << 63:
        a = _named(a, int(a.max()) + 1)[0]
    return a.astype(np.int64) * b_size + b


def _named(keys: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Names of keys below ``size``, from 0 in their order, and how many there are."""
    if size <= 4 * len(keys) + 1024:
        there = np.zeros(size, bool)
        there[keys] = True
        names = np.cumsum(there)
        return names[keys] - 1, int(names[-1])
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = held[1:] != held[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix of ``text`` (positive numbers), from 0, by the difference cover
    {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(n)
        return ranks
    s = np.concatenate((text, np.zeros(4, np.int64)))
    top = int(text.max()) + 1
    # one sample beyond the end where needed, so that every first part ends in a mark of its own
    at = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    triples = _paired(_paired(s[at], s[at + 1], top), s[at + 2], top)
    ranks, names = _named(triples, int(triples.max()) + 1)
    if names < len(at):
        ranks = suffix_ranks(ranks + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[at] = ranks + 1
    wide = len(at) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_paired(s[rest], rank[rest + 1], wide))]
    # of the samples below each of the rest: those of either residue are in order by these keys
    order = np.empty(len(at), np.int64)
    order[ranks] = at
    order = order[order < n]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    pairs = _paired(s[:-1], s[1:], top)
    if (int(pairs.max()) + 1) * wide >= 1 << 63:
        pairs = _named(pairs, int(pairs.max()) + 1)[0]
    below = np.searchsorted(s[ones] * wide + rank[ones + 1], s[rest] * wide + rank[rest + 1])
    below += np.searchsorted(pairs[twos] * wide + rank[twos + 2], pairs[rest] * wide + rank[rest + 2])
    place = np.empty(n, np.int64)
    slots = below + np.arange(len(rest))
    place[rest] = slots
    free = np.ones(n, bool)
    free[slots] = False
    place[order] = np.flatnonzero(free)
    return place


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` (rising) are equal to another of them."""
    used = np.zeros(256, np.int64)
    used[text] = 1
    order = np.empty(len(text), np.int64)
    order[suffix_ranks(np.cumsum(used)[text])] = np.arange(len(text))
    asked = np.zeros(len(text), bool)
    asked[starts] = True
    sorted_starts = order[asked[order]]
    same = np.zeros(len(starts) + 1, bool)
    alive = np.arange(1, len(starts))
    wide = min(8, length)
    words = np.zeros(len(text), np.uint64)
    for k in range(wide):
        words[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    for at in [*range(0, length - wide, wide), length - wide]:
        alive = alive[words[sorted_starts[alive] + at] == words[sorted_starts[alive - 1] + at]]
    same[alive] = True
    found = np.zeros(len(text), bool)
    found[sorted_starts] = same[:-1] | same[1:]
    return found[starts]


def _marked_runs(flags: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true flags; no run goes on where ``new`` is true."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | new[1:]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | new[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _sorted_task(length: int, table: pa.Table) -> pa.Table:
    """Runs of repeated strings of those stretches of some cores that occur once."""
    texts = [t.as_buffer().to_pybytes() for t in table["text"]]
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    starts = (np.cumsum(sizes) - sizes)[owner] + within
    found = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), starts, length)
    found &= ~table["twice"].to_numpy()[owner]
    first, stop = _marked_runs(found, within == 0)
    at = owner[first]
    begin = table["begin"].to_numpy()[at] + within[first]
    columns = [table["block"].to_numpy()[at], begin, begin + stop - first]
    return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def _single_strings(length: int, batches):
    """Every string of the stretches of cores that have very many, by its digest."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "begin", "twice", "text")]
        for block, begin, twice, text in zip(*columns):
            keys = [hashlib.blake2b(text[i : i + length], digest_size=16).digest() for i in range(len(text) - length + 1)]
            n = len(keys)
            arrays = [[block] * n, [begin] * n, list(range(begin, begin + n)), keys, [2 if twice else 1] * n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()))],
                ["block", "begin", "at", "key", "n"],
            )


def _joined_starts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    at = np.sort(table["at"].to_numpy())
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    end = at[np.append(new[1:], True)] + 1
    columns = [np.full(len(end), key[0].as_py(), np.int64), at[new], end]
    return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def repeated_runs(texts: DataFrame, length: int, stretches: int = STRETCHES) -> DataFrame:
    """``(block, begin, end)``: the runs of repeated strings of the stretches that occur once."""
    sizes = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    tasks = max(1, -(-sizes // SORTED_BYTES))
    many = stored(texts.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stretches).select("core"), "many")
    # without such cores the texts are exchanged once, for their tasks
    none = many.isEmpty()
    usual = texts if none else texts.join(many, "core", "left_anti")
    dealt = usual.withColumn("task", F.pmod(F.xxhash64("core"), F.lit(tasks)))

    def task(rows: pa.Table) -> pa.Table:
        return _sorted_task(length, rows)

    found = dealt.groupBy("task").applyInArrow(task, _FOUND)
    if none:
        return found
    strings = texts.join(many, "core", "left_semi").mapInArrow(
        partial(_single_strings, length), "block long, begin int, at int, key binary, n int"
    )
    repeated = strings.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1").select("key")
    single = strings.join(repeated, "key", "left_semi").groupBy("block", "begin").applyInArrow(_joined_starts, _FOUND)
    return found.unionByName(single)


# Result --------------------------------------------------------------------------


def _spans(sizes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end of the joined spans; none goes beyond its document."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    # a document without bytes begins where the next one does
    owner = np.searchsorted(np.cumsum(sizes) - sizes, begin, "right") - 1
    far = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > far[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], begin[new], far[np.append(new[1:], True)] if len(new) else far


def _cut(length: int, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """What is left of a block's documents."""
    if not len(blocks):
        return _RESULT_ARROW.empty_table()
    packed, sizes, ids, again = (blocks[c][0].as_py() for c in ("packed", "sizes", "ids", "again"))
    whole = _whole(packed)
    sizes = np.array(sizes, np.int64)
    recur = np.frombuffer(again, "<i4").reshape(-1, 2).astype(np.int64)
    begin, end = (np.concatenate((answers[c].to_numpy(), recur[:, k])) for k, c in enumerate(("begin", "end")))
    owner, begin, end = _spans(sizes, begin, end + length - 1)
    firsts = np.cumsum(sizes) - sizes
    cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes))))).tolist()
    gone = np.bincount(owner, end - begin, minlength=len(sizes)).astype(np.int64)
    removed = np.stack((begin, end), axis=1).ravel().tolist()
    kept = []
    for k, (at, stop) in enumerate(zip(firsts.tolist(), (firsts + sizes).tolist())):
        if cuts[k] == cuts[k + 1]:
            kept.append(whole[at:stop])
            continue
        edges = [at, *removed[2 * cuts[k] : 2 * cuts[k + 1]], stop]
        kept.append(b"".join([whole[a:b] for a, b in zip(edges[0::2], edges[1::2])]))
    held = pa.StructArray.from_arrays([pa.array(begin - firsts[owner]), pa.array(end - firsts[owner])], [n for n, _ in _SPAN])
    spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), held)
    columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(gone), spans, pa.array(kept, pa.binary())]
    return pa.table(columns, schema=_RESULT_ARROW)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stretches: int = STRETCHES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (removed, of bytes) and kept."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    blocks = stored(narrow.mapInArrow(partial(_blocks, length, BLOCK_BYTES), _BLOCKS), "blocks")
    inline = F.inline("runs").alias("core", "stretch", "begin", "starts", "n", "again")
    runs = blocks.select("block", inline).select("core", "stretch", "begin", "starts", "n", "again", "block")
    sorted_runs = runs.repartition("core").sortWithinPartitions("core", "stretch", "block")
    met = stored(sorted_runs.mapInArrow(_met, _MET), "stretches-met")
    sent = met.where("sent").select("core", "block", "begin", "starts", "twice").groupBy("block")
    texts = stored(
        blocks.select("block", "packed").groupBy("block").cogroup(sent).applyInArrow(partial(_texts, length), _SENT),
        "stretches",
    )
    told = met.where("told").select("block", "begin", (F.col("begin") + F.col("starts")).alias("end"))
    answers = told.unionByName(repeated_runs(texts, length, stretches)).groupBy("block")
    held = blocks.select("block", "ids", "sizes", "packed", "again").groupBy("block")
    return held.cogroup(answers).applyInArrow(partial(_cut, length), _RESULT)
