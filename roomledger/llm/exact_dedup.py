"""Exact deduplication by Grace hashing.

Two passes share one routine. In the first, each task groups its own rows, so a
text leaves a task once however often it occurs there. In the second, these
distinct texts are dealt out by digest (the outermost partitioning) and grouped
again. The routine inserts records into an open-addressing table that compares
complete contents; once the table holds ``budget`` bytes, records that match
nothing in it go to spill files by further digest bits, and each file is
grouped in turn, one level deeper. Copies never take table space, so a bucket
made of one huge group needs no splitting.

Only the groups' answers travel back: rows of a task find them under (task,
group in the task), a key that holds no more rows than a task.

Defined cases: null text is empty, and empty texts are equal; a null id sorts
below all others; repeated rows are members like any other, and exactly one row
of a group stays; an empty table gives no rows; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import UPPER, discard, documents, marked, stored, without

BUDGET = 96 << 20
FANOUT = 16
_HEAD = struct.Struct("<II")


class ContentTable:
    """Open addressing with linear probing; equality is equality of contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.members: list[list[bytes]] = []
        self.size = 0

    def _start(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (len(self.slots) - 1)

    def probe(self, content: bytes, digest: bytes) -> tuple[int, int]:
        """The free slot or the slot of the content, and the entry or -1."""
        at, mask = self._start(digest), len(self.slots) - 1
        while (entry := self.slots[at]) >= 0:
            if self.contents[entry] == content:
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def insert(self, at: int, content: bytes, digest: bytes, member: bytes) -> None:
        self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.digests.append(digest)
        self.members.append([member])
        self.size += len(content) + 128
        if 2 * len(self.contents) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = self._start(digest)
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _read(path: str) -> Iterator[tuple[bytes, bytes]]:
    with open(path, "rb", buffering=1 << 20) as file:
        while head := file.read(_HEAD.size):
            n, m = _HEAD.unpack(head)
            yield file.read(n), file.read(m)


def grouped(
    records: Iterable[tuple[bytes, bytes]], budget: int = BUDGET, level: int = 0
) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """``(content, digest, members)`` of each distinct content of ``(content, member)``.

    Spill files are this task's own and are deleted as they are read.
    """
    held = ContentTable()
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files: dict[int, object] = {}
        for content, member in records:
            digest = hashlib.sha256(content).digest()
            at, entry = held.probe(content, digest)
            if entry >= 0:
                held.members[entry].append(member)
            elif held.size < budget or not held.contents:
                held.insert(at, content, digest, member)
            else:
                part = (digest[8 + level % 24] >> 4 * (level // 24 % 2)) % FANOUT
                if part not in files:
                    files[part] = open(os.path.join(folder, str(part)), "wb", buffering=1 << 18)
                files[part].write(_HEAD.pack(len(content), len(member)) + content + member)
        yield from zip(held.contents, held.digests, held.members)
        del held
        for file in files.values():
            file.close()
        for file in files.values():
            yield from grouped(_read(file.name), budget, level + 1)
            os.remove(file.name)


_ROW = struct.Struct("<?q")
_RECORD = struct.Struct("<iq?qq")

LOCAL = "doc_id long, first boolean, block int, grp long, digest binary, content binary, size long"
ANSWER = "block int, grp long, keep_id long, group_size long, wins boolean"


def _batched(rows: Iterator[tuple], schema: pa.Schema, rows_max: int = 4096, bytes_max: int = 16 << 20):
    """Record batches of bounded size; the last bytes value of a row counts as its size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= rows_max or size >= bytes_max:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema
            )
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema
        )


_LOCAL_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("first", pa.bool_()), ("block", pa.int32()), ("grp", pa.int64())]
    + [("digest", pa.binary()), ("content", pa.binary()), ("size", pa.int64())]
)
_ANSWER_ARROW = pa.schema(
    [("block", pa.int32()), ("grp", pa.int64()), ("keep_id", pa.int64())]
    + [("group_size", pa.int64()), ("wins", pa.bool_())]
)


def _within_task(budget: int, batches):
    block = TaskContext.get().partitionId()

    def records():
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                # bytes.lower() changes A-Z alone
                yield text.as_py().lower(), _ROW.pack(doc_id is not None, doc_id or 0)

    def rows():
        for grp, (content, digest, members) in enumerate(grouped(records(), budget)):
            ids = [_ROW.unpack(m) for m in members]
            best = max(range(len(ids)), key=lambda i: (ids[i], -i))
            for i, (known, doc_id) in enumerate(ids):
                first = i == best
                yield (
                    doc_id if known else None,
                    first,
                    block,
                    grp,
                    digest,
                    content if first else None,
                    len(ids),
                )

    yield from _batched(rows(), _LOCAL_ARROW)


def _across_tasks(budget: int, batches):
    def records():
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for doc_id, block, grp, size, content in zip(*columns):
                known = doc_id.is_valid
                meta = _RECORD.pack(
                    block.as_py(), grp.as_py(), known, doc_id.as_py() or 0, size.as_py()
                )
                yield content.as_py(), meta

    def rows():
        for _, _, members in grouped(records(), budget):
            held = [_RECORD.unpack(m) for m in members]
            best = max(held, key=lambda r: (r[2], r[3], -r[0], -r[1]))
            total = sum(r[4] for r in held)
            for r in held:
                yield r[0], r[1], best[3] if best[2] else None, total, r[:2] == best[:2]

    yield from _batched(rows(), _ANSWER_ARROW)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _answered(_local_groups(docs, id_col, text_col, budget), budget)


def _local_groups(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    return stored(
        documents(docs, id_col, text_col).mapInArrow(partial(_within_task, budget), LOCAL), "exact-local"
    )


def _answered(local: DataFrame, budget: int) -> DataFrame:
    answers = (
        local.where("first")
        .select("doc_id", "block", "grp", "size", "content", "digest")
        .repartition("digest")
        .drop("digest")
        .mapInArrow(partial(_across_tasks, budget), ANSWER)
    )
    return (
        local.select("doc_id", "first", "block", "grp", "digest")
        .join(answers, ["block", "grp"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("first") & F.col("wins")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """One row of ``docs`` for each text, one with the largest id.

    Ids that occur once are dropped by the id. Of ids that occur more often, each row is
    decided by its id and the digest of its text; which of the rows that are equal in
    both goes on is left open.
    """
    local = _local_groups(docs, id_col, text_col, budget)
    groups = _answered(local, budget).select("doc_id", "kept", "text_sha256")
    repeated = local.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "exact-repeated")
    if repeated.isEmpty():
        gone = stored(groups.where(~F.col("kept")).select("doc_id"), "exact-gone")
        discard(local, repeated)
        return without(docs, gone, id_col)
    groups = stored(groups, "exact-answers")
    discard(local)
    gone = groups.where(~F.col("kept")).select("doc_id").union(repeated).distinct()
    once = without(docs, stored(gone, "exact-gone"), id_col)
    known = F.col("doc_id").eqNullSafe(F.col("_repeated"))
    winners = groups.where("kept").join(repeated.withColumnRenamed("doc_id", "_repeated"), known)
    winners = winners.select(F.col("doc_id").alias("_won_id"), F.col("text_sha256").alias("_won_sha"))
    plain = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower())
    # equal rows meet within their tasks first
    again = (
        marked(docs, repeated, id_col)
        .where("_maybe")
        .drop("_maybe")
        .withColumn("_exact_id", F.col(id_col).cast("bigint"))
        .withColumn("_exact_sha", F.sha2(plain, 256))
        .dropDuplicates(["_exact_id", "_exact_sha"])
    )
    won = F.col("_exact_id").eqNullSafe(F.col("_won_id")) & (F.col("_exact_sha") == F.col("_won_sha"))
    again = again.join(winners, won, "left_semi").drop("_exact_id", "_exact_sha")
    return once.unionByName(again)
