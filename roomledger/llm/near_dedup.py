"""Near-duplicate groups by b-bit MinHash.

1. Every text becomes its set of hashed shingles. ``HASHES`` minima of it are taken; all
   bits of them key the bands, and their ``BITS`` low bits are packed into longs.
2. Documents with equal sets form a class; the smallest id of a class stands for it
   from here on, so copies never meet each other again.
3. Representatives that share a band form a bucket. Each is paired with its bucket's
   smallest id only, first in ``EARLY`` bands, then in all, where a row keeps the
   ``FIRST`` smallest ids that share most bands with it. The similarity of a pair is
   estimated from the bit counts of the packed signatures, corrected for values that
   agree by chance; pairs whose estimate lies more than ``SIGMAS`` standard deviations
   below the threshold are dropped, the others are decided on full sets.
4. Decided links are joined to components, and buckets within one component are done.
   A bucket that still holds several components may hide links between them: there, rows
   are written as their differences from the bucket's head, and meet only where they
   share differences, rarest first, that a link cannot do without (``_apart``). Links
   within a component change nothing and are not looked for. So every candidate pair is
   decided, proven to be no link, or already connected; none is capped.

Full sets are made anew from the texts of the documents in question: once for the pairs
of the ``EARLY`` bands, and once for all rows of the buckets that are mixed after them. A
bitmap of their hashed ids, broadcast to the scan, keeps most other texts out of that
exchange; it is a filter only, the join on the id decides.

Every Spark action costs the driver memory for its plan, threads, broadcasts and
exchanges, however few rows it has. So steps that have nothing left to do are skipped.

A link at the threshold shares no band with probability below 3e-7, and is below the
estimate's bound with probability below 3e-7.

Defined cases: null and blank texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle; repeated rows are members of one class;
rows with a null id take no part, are kept and have a null component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.llm.common import discard, documents, marked, release_worker, stored, without
from roomledger.llm.tokens import strings
from roomledger.plans.numbering import number_rows

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 6
#: Signatures hold more minima than the bands use.
HASHES = 2 * BANDS * ROWS
BITS = 2
LONGS = HASHES * BITS // 64
SIGMAS = 5.0
EARLY = 2
FIRST = 3
SPREAD = 256
ROWS_AT_ONCE = 2000
HASHED_AT_ONCE = 1024

_RANDOM = np.random.default_rng(20)
_FACTORS = (_RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * 2 + 1)[:, None]
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
_PLACES = _RANDOM.integers(0, 1 << 62, WORDS, np.uint64) * 2 + 1
_BAND_PLACES = _RANDOM.integers(0, 1 << 62, ROWS, np.uint64) * 2 + 1
_BAND_SEEDS = _RANDOM.integers(0, 1 << 62, BANDS, np.uint64)

SIGNED = (
    "doc_id long, n_shingles long, set_sum long, set_mix long, bands array<long>, bits array<long>"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_sum", pa.int64())]
    + [("set_mix", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
)
_SET = ["set_sum", "set_mix", "n_shingles"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.values.dictionary_encode()
    known = strings(coded.dictionary)
    hashes = pd.util.hash_array(np.asarray(known, object), categorize=False) if len(known) else None
    codes = coded.indices.to_numpy()
    real = np.array([w != "" for w in known], bool)[codes] if len(known) else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(real)))[words.offsets.to_numpy()]
    flat = _mixed(hashes[codes[real]]) if len(known) else np.zeros(0, np.uint64)
    n = max(0, len(flat) - WORDS + 1)
    shingles = np.zeros(n, np.uint64)
    for place in range(WORDS):
        shingles += flat[place : place + n] * _PLACES[place]
    shingles = _mixed(shingles)
    sets = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= WORDS:
            sets.append(np.unique(shingles[a : b - WORDS + 1]))
        elif b > a:
            whole = (flat[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(_mixed(np.array([whole], np.uint64) * _PLACES[0]))
        else:
            sets.append(flat[:0])
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minimum of the set under each hash function."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    found = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), HASHED_AT_ONCE):
        x = low[None, at : at + HASHED_AT_ONCE] * _FACTORS
        x += _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        np.minimum(found, x.min(axis=1), out=found)
    return found


def _signed(batches):
    release_worker()
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            sets = shingle_sets(part.column(1))
            lowest = np.array([minima(s) for s in sets], np.uint32).reshape(-1, HASHES)
            keyed = (lowest[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND_PLACES).sum(axis=2)
            bands = _mixed(_mixed(keyed) + _BAND_SEEDS).view(np.int64)
            planes = [np.packbits((lowest >> np.uint32(b)) & 1, axis=1) for b in range(BITS)]
            bits = np.ascontiguousarray(np.hstack(planes)).view(np.int64)
            filled = np.array([len(s) > 0 for s in sets], bool)
            columns = [
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.array(
                    np.array(
                        [np.bitwise_xor.reduce(_mixed(s)) for s in sets], np.uint64
                    ).view(np.int64)
                ),
                _lists(bands, filled),
                _lists(bits, filled),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _lists(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    """One list per row, empty where the row has no shingles."""
    ends = np.concatenate(([0], np.cumsum(filled * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[filled].ravel()))


def estimate(one: Column, other: Column) -> Column:
    """Similarity from two packed signatures: agreeing values beyond chance."""
    differ = F.lit(0)
    for i in range(LONGS // BITS):
        planes = [one[i + p * (LONGS // BITS)].bitwiseXOR(other[i + p * (LONGS // BITS)]) for p in range(BITS)]
        differ = differ + F.bit_count(functools.reduce(Column.bitwiseOR, planes))
    chance = 1 / (1 << BITS)
    agree = 1 - differ / HASHES
    return (agree - chance) / (1 - chance)


def lowest_estimate(percent: int = PERCENT) -> float:
    """Below it a pair at the threshold lies more than ``SIGMAS`` deviations off."""
    chance, similarity = 1 / (1 << BITS), percent / 100
    agree = similarity + (1 - similarity) * chance
    return similarity - SIGMAS * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node either points to one lower node or is pointed to."""
    ends = edges.select("a", (F.col("a") > F.col("b")).cast("int").alias("up"), F.lit(1).alias("out"))
    ends = ends.union(edges.select("b", F.lit(1), F.lit(0)))
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n"), F.min("up").alias("up"))
    return nodes.where("up = 0 OR out > 1 OR (out = 1 AND n > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star rounds; every round is written to the shared folder.
    """
    return _contracted(stored(edges.select("a", "b").where("a <> b").distinct(), "edges"))


def _contracted(now: DataFrame) -> DataFrame:
    """``components`` of distinct stored edges without loops."""
    while not _is_star_forest(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # each row now points down: the small star of a row is its own lower neighbours
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stored(small, "edges")
    top = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top), "components")


def _sets(batches):
    release_worker()
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)


def _decided(percent, batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        one, other = batch.column(2), batch.column(3)
        linked = []
        for x, y in zip(one, other):
            x = np.frombuffer(x.as_buffer(), "<u8")
            y = np.frombuffer(y.as_buffer(), "<u8")
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
        kept = batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns, schema=schema)


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, shingles)``: the full sets of the texts with these ids, one for each id."""
    near = marked(texts, ids).where("_maybe").select("doc_id", "text")
    near = near.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(near.mapInArrow(_sets, "doc_id long, shingles binary"), "shingles")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("other"))
    held = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "one", "other")
    return stored(held.mapInArrow(functools.partial(_decided, percent), "a long, b long"), "links")


class _Groups:
    """Representatives and the components found so far, none before the first links."""

    def __init__(self, chosen: DataFrame) -> None:
        self.chosen = chosen
        self.parts: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component ``part`` of their ``rep``."""
        if self.parts is None:
            return rows.withColumn("part", F.col("rep"))
        joined = rows.join(self.parts, F.col("rep") == F.col("node"), "left")
        part = F.coalesce("component", "rep").alias("part")
        return joined.select(*rows.columns, part)

    def connect(self, links: DataFrame) -> bool:
        """Joins the components that the links (distinct, stored) connect; whether there were
        any to join."""
        if links.isEmpty():
            return False
        if self.parts is None:
            self.parts = _contracted(links)
            return True
        ends = []
        for end in ("a", "b"):
            known = self.parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            links = links.join(known, end, "left")
            ends.append(F.coalesce(f"of_{end}", end).alias(end))
        links = stored(links.select(*ends).where("a <> b").distinct(), "edges")
        if links.isEmpty():
            return False
        new = _contracted(links)
        moved = self.parts.join(
            new.select(F.col("node").alias("component"), F.col("component").alias("_now")),
            "component",
            "left",
        ).select("node", F.coalesce("_now", "component").alias("component"))
        fresh = new.join(self.parts.select("node"), "node", "left_anti")
        self.parts = stored(moved.unionByName(fresh), "components")
        return True


def _mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows (band, rep, part, ...) whose bucket holds several components, with the
    bucket's ``head``, its component ``of_head`` and ``members``."""
    buckets = rows.groupBy("band").agg(
        F.min("part").alias("_low"),
        F.max("part").alias("_high"),
        F.min("rep").alias("head"),
        F.min_by("part", "rep").alias("of_head"),
        F.count(F.lit(1)).alias("members"),
    )
    return rows.join(buckets.where("_low < _high").drop("_low", "_high"), "band")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = documents(docs, id_col, text_col)
    signed = stored(texts.mapInArrow(_signed, SIGNED), "signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy(*_SET).agg(F.min("doc_id").alias("rep")), "classes")
    same = [known[c] == classes[c] for c in _SET] + [known["doc_id"] == classes["rep"]]
    chosen = known.join(classes, same, "left_semi").dropDuplicates(["doc_id"])
    chosen = stored(chosen.select(F.col("doc_id").alias("rep"), "bands", "bits"), "representatives")
    groups, floor, tried = _Groups(chosen), lowest_estimate(percent), None

    def decide(pairs: DataFrame, sets: DataFrame | None = None) -> bool:
        """Whether components were joined. ``sets``: those of all ends, if there are any yet."""
        nonlocal tried
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if pairs.isEmpty():
            return False
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if sets is not None:
            near = marked(sets, ids).where("_maybe").select("doc_id", "shingles")
            return groups.connect(_links(pairs, near, percent))
        sets = _sets_of(texts, ids)
        joined = groups.connect(_links(pairs, sets, percent))
        discard(sets)
        return joined

    early = groups.labelled(chosen.select("rep", F.explode(F.slice("bands", 1, EARLY)).alias("band")))
    decide(_stars(_mixed_buckets(early), chosen, floor))
    # buckets that one component holds now stay so
    every = groups.labelled(chosen.select("rep", "bands")).select("rep", "part", F.explode("bands").alias("band"))
    bucketed = stored(_mixed_buckets(every), "buckets")
    if not bucketed.isEmpty():
        # heads are members, so these are the ends of all later pairs
        sets = _sets_of(texts, bucketed.select(F.col("rep").alias("doc_id")).distinct())
        decide(_stars(bucketed, chosen, floor), sets)
        _apart(groups.labelled(bucketed.select("band", "rep")), groups, sets, floor, percent, decide)
        discard(sets)
    discard(bucketed, chosen)

    named = groups.labelled(classes).select(*_SET, F.col("part").alias("component_id"))
    # a class of very many copies meets its name in SPREAD parts
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).alias("_part")
    narrow = signed.select("doc_id", *_SET, part)
    member = narrow.where("n_shingles > 0 AND doc_id IS NOT NULL")
    spread = member.select(*_SET, "_part").distinct().join(named, _SET)
    found = member.join(spread, [*_SET, "_part"]).select("doc_id", "n_shingles", "component_id")
    alone = narrow.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.union(alone).withColumn("kept", kept)


def _stars(rows: DataFrame, chosen: DataFrame, floor: float) -> DataFrame:
    """``(a, b)``: the head of a mixed bucket and a row of another component, if similar."""
    shared = rows.where("part <> of_head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b"))
    most = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    pairs = shared.agg(F.count(F.lit(1)).alias("n")).withColumn("_place", F.row_number().over(most))
    pairs = pairs.where(F.col("_place") <= FIRST).select("a", "b")
    bits = chosen.select("rep", "bits")
    return (
        pairs.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("one")), "a")
        .join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("other")), "b")
        .where(estimate(F.col("one"), F.col("other")) >= floor)
        .select("a", "b")
    )


def _differences(percent: int, batches):
    """Shingles by which a row differs from its bucket's head, and the row's ``excess``:
    two rows are linked if their excesses add up to at most 2 * (100 + percent) times the
    number of differences they share."""
    release_worker()
    schema = pa.schema([("head", pa.int64()), ("rep", pa.int64()), ("excess", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        excess, tokens = [], []
        for one, other in zip(batch.column(2), batch.column(3)):
            x, h = (np.frombuffer(v.as_buffer(), "<u8") for v in (one, other))
            d = np.setxor1d(x, h, assume_unique=True)
            excess.append((100 + percent) * len(d) - (100 - percent) * len(x))
            tokens.append(d.view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(excess, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _apart(rows: DataFrame, groups: _Groups, sets: DataFrame, floor: float, percent: int, decide) -> None:
    """Finds the links between rows of a bucket in different components.

    Rows are compared through their differences from the bucket's head. Rows with few
    differences are linked outright, which the one with the least excess stands for. All
    other links share differences, and more of them the more excess both rows have. With
    the differences in one order, rarest in the bucket first, the first that both rows have
    must leave as many in either row as the link needs. So rows of one template that are
    similar but not linked hardly meet: what many of them share comes too late.
    """
    held = _mixed_buckets(rows)
    topics = stored(held.select("head", "rep").distinct(), "topics")
    if topics.isEmpty():
        discard(topics)
        return
    one = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("one"))
    other = sets.select(F.col("doc_id").alias("head"), F.col("shingles").alias("other"))
    pairs = topics.join(one, "rep").join(other, "head").select("head", "rep", "one", "other")
    apart = stored(
        pairs.mapInArrow(functools.partial(_differences, percent), "head long, rep long, excess long, tokens array<long>"),
        "differences",
    )
    nearest = apart.groupBy("head").agg(F.min(F.struct("excess", "rep")).alias("near"))
    outright = apart.select("head", "rep", "excess").join(nearest, "head").where(
        (F.col("excess") + F.col("near.excess") <= 0) & (F.col("rep") != F.col("near.rep"))
    )
    groups.connect(stored(outright.select(F.col("rep").alias("a"), F.col("near.rep").alias("b")).distinct(), "links"))

    parts = groups.labelled(apart.select("head", "rep")).groupBy("head").agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
    mixed = apart.join(parts.where("_low < _high").select("head"), "head")
    tokens = stored(
        mixed.select("rep", "excess", F.col("head").alias("_head"), F.explode("tokens").alias("token"))
        .select("rep", "excess", "_head", F.xxhash64("_head", "token").alias("band")), "differences",
    )
    times = tokens.groupBy("band").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # what a link shares from this difference on, in the order of rarity, is at most ``spare``
    order = Window.partitionBy("_head", "rep").orderBy(F.desc("times"), F.desc("band"))
    ranked = tokens.join(times, "band").select("band", "rep", "excess", F.row_number().over(order).alias("spare"))
    ranked = stored(ranked.withColumn("prefix", F.col("spare") * (100 + percent) >= F.col("excess")), "prefixes")
    asked = ranked.where("prefix").groupBy("band").agg(F.min("excess").alias("low"))
    both = 2 * (100 + percent)
    meeting = ranked.join(asked, "band").where(F.col("spare") * both >= F.col("excess") + F.col("low"))
    meeting = stored(meeting.drop("low"), "prefixes")
    named = stored(_mixed_buckets(groups.labelled(meeting)), "meetings")
    done = [topics, apart, tokens, ranked, meeting, named]
    if named.isEmpty():
        discard(*done)
        return
    if decide(_stars(named, groups.chosen, floor), sets):
        # buckets that one component holds now stay so
        named = stored(_mixed_buckets(groups.labelled(named.select(*meeting.columns))), "meetings")
        done.append(named)
    left, right = named.where("prefix").alias("l"), named.alias("r")
    less = F.struct("l.excess", "l.rep") < F.struct("r.excess", "r.rep")
    enough = F.least("l.spare", "r.spare") * both >= F.col("l.excess") + F.col("r.excess")
    apart_still = (F.col("l.band") == F.col("r.band")) & (F.col("l.part") != F.col("r.part"))
    met = left.join(right, apart_still & less & enough)
    decide(met.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct(), sets)
    discard(*done)


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` that stand for their group, and those with a null id.

    Where ids are repeated, rows are numbered in the order of ids, and each is decided.
    """
    row_id = F.col(id_col).cast("bigint")
    times = docs.where(row_id.isNotNull()).groupBy(row_id.alias("doc_id")).count()
    if not times.where("count > 1").isEmpty():
        docs, id_col = stored(number_rows(docs, row_id, "_near_row"), "near-rows"), "_near_row"
    groups = near_groups(docs, id_col, text_col, percent)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, stored(gone, "near-gone"), id_col).drop("_near_row")
