"""Token counts of documents from piece counts of distinct pre-tokens.

A task splits its documents into pre-tokens and keeps, per document, how often each
occurs. Each distinct pre-token of a task leaves it once; over the corpus each is
given to the tokenizer once and yields its number of pieces; the numbers go back to
the tasks' dictionaries and are summed over the frequencies. No ids are formed.

Pre-tokens that are one vocabulary entry count 1 and need no exchange: a table
bounded by the vocabulary. The frequencies of all others travel as packed arrays of
dictionary places. Pre-tokens are dealt out by themselves and sorted, so that equal ones
are counted once and answer all tasks that asked; none, however common, has more rows
than there are tasks. The answers are packed per asking task and joined to its documents'
frequencies.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted each;
null ids are kept; an empty table gives no rows; other columns are not read. Texts with
control characters on which Python and the tokenizer disagree about white space are
counted by the library whole.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import documents, stored
from roomledger.llm.tokens import ODD, RUN, BytePretokens, gathered, safe_pieces, strings

LIMIT = 1024
#: A dictionary is closed, and a new one begun, at so many entries.
PLACES = 400_000
ROWS_AT_ONCE = 2500

FREQUENCIES = (
    "block long, doc_id long, n_bytes long, known long, times binary, place int, pretoken string"
)
_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64())]
    + [("times", pa.binary()), ("place", pa.int32()), ("pretoken", pa.string())]
)
_ANSWER = pa.schema([("home", pa.int64()), ("pieces", pa.binary())])
#: Answers are packed once so many are held.
ANSWERS_AT_ONCE = 500_000


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, and where each value ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 6):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        on = sizes > k
        low = (values[on] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[on] - sizes[on] + k] = low | ((sizes[on] - 1 > k).astype(np.uint8) << 7)
    return out, ends


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and how many end up to each byte."""
    last = data < 128
    upto = np.cumsum(last)
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - starts[upto - last] if len(data) else starts
    parts = (data & 127).astype(np.int64) << (7 * place)
    return (np.add.reduceat(parts, starts) if len(data) else parts), upto


@functools.lru_cache(maxsize=1)
def _pretokens(path: str) -> tuple[BytePretokens, set[str]]:
    held = BytePretokens(path)
    return held, held.single()


class _Block:
    """Documents and the dictionary of their pre-tokens that are no single piece."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.places: dict[str, int] = {}

    def coded(self, pretokens: list[str], single: set[str]) -> bytes:
        """Places of pre-tokens, 1 upwards; 0 stands for any single piece."""
        places = self.places
        found = [
            0 if p in single else places.get(p) or places.setdefault(p, len(places) + 1)
            for p in pretokens
        ]
        return np.array(found, "<u4").tobytes()

    def dictionary(self) -> pa.RecordBatch:
        n = len(self.places)
        empty = [pa.nulls(n, t) for t in _ARROW.types[1:5]]
        columns = [pa.array([self.number] * n, pa.int64()), *empty]
        columns += [pa.array(range(1, n + 1), pa.int32()), pa.array(list(self.places), pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _frequencies(path: str, batches):
    tokens, single = _pretokens(path)
    task = TaskContext.get().partitionId() << 24
    block = _Block(task)
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            yield _coded_batch(part, block, tokens, single)
            if len(block.places) >= PLACES:
                yield block.dictionary()
                block = _Block(block.number + 1)
    if block.places:
        yield block.dictionary()


def _coded_batch(part, block: _Block, tokens: BytePretokens, single: set[str]) -> pa.RecordBatch:
    texts = strings(part.column(1))
    firsts, apart, plain = [], {}, list(texts)
    for i, text in enumerate(texts):
        if ODD.search(text):
            ids = tokens.whole.encode(text, add_special_tokens=False).ids
            apart[i], plain[i] = np.zeros(len(ids), "<u4").tobytes(), ""
        elif RUN.search(text):
            head, *rest = safe_pieces(text)
            found = tokens.split(head) + list(chain.from_iterable(tokens.split(" " + r) for r in rest))
            apart[i], plain[i] = block.coded(found, single), ""
        if i in apart:
            firsts.append(apart[i])
        else:
            head = text.split(" ", 1)[0]
            firsts.append(block.coded(tokens.split(head), single))
    pieces = pc.split_pattern(pa.array(plain, pa.string()), " ")
    coded = pieces.values.dictionary_encode()
    pool = [block.coded(tokens.split(" " + c), single) for c in strings(coded.dictionary)]
    # the first piece of a text has no blank before it and is in ``firsts``
    codes, offsets = coded.indices.to_numpy().copy(), pieces.offsets.to_numpy()
    pool.append(b"")
    codes[offsets[:-1]] = len(pool) - 1
    places, ends = gathered(pool, codes, offsets)
    rows = part.num_rows
    sizes = np.fromiter(map(len, firsts), np.int64, rows) // 4
    every = np.concatenate((np.frombuffer(b"".join(firsts), "<u4"), places)).astype(np.int64)
    owner = np.concatenate((np.repeat(np.arange(rows), sizes), np.repeat(np.arange(rows), np.diff(ends))))
    known = np.bincount(owner[every == 0], minlength=rows)
    key, times = np.unique((owner << 32 | every)[every > 0], return_counts=True)
    owner, place = key >> 32, key & 0xFFFFFFFF
    # (step from the place before, times - 1) for each place of a document
    steps = np.diff(place, prepend=0)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    steps[first] = place[first]
    data, stops = packed(np.stack((steps, times - 1), axis=1).ravel())
    cuts = np.concatenate(([0], stops))[2 * np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))]
    columns = [pa.array([block.number] * rows, pa.int64()), part.column(0)]
    columns += [pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(known, pa.int64())]
    whole = data.tobytes()
    columns += [pa.array([whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())]
    columns += [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _answers(path: str, batches):
    """Pieces of sorted pre-tokens, packed per asking block as (step, pieces)."""
    tokens, _ = _pretokens(path)
    last, pieces = None, 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        runs = batch.column(2).dictionary_encode()
        each = []
        for pretoken in strings(runs.dictionary):
            if pretoken != last:
                last, pieces = pretoken, tokens.pieces(pretoken)
            each.append(pieces)
        counts = np.array(each, np.int64)[runs.indices.to_numpy()]
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts))
        size += batch.num_rows
        if size >= ANSWERS_AT_ONCE:
            yield _packed_answers(held)
            held, size = [], 0
    if held:
        yield _packed_answers(held)


def _packed_answers(held) -> pa.RecordBatch:
    home, place, pieces = (np.concatenate(c).astype(np.int64) for c in zip(*held))
    order = np.lexsort((place, home))
    home, place, pieces = home[order], place[order], pieces[order]
    first = np.flatnonzero(np.diff(home, prepend=-1))
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    data, stops = packed(np.stack((steps, pieces), axis=1).ravel())
    cuts = np.concatenate(([0], stops))[2 * np.concatenate((first, [len(home)]))]
    whole = data.tobytes()
    values = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(home[first]), pa.array(values, pa.binary())], schema=_ANSWER)


def _pairs(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, number)`` of packed (step, number) pairs, a row per value."""
    found, upto = unpacked(np.frombuffer(b"".join(values), np.uint8))
    ends = np.concatenate(([0], upto))[np.cumsum([0, *map(len, values)])] // 2
    steps, numbers = found[0::2], found[1::2]
    row = np.repeat(np.arange(len(values)), np.diff(ends))
    total = np.cumsum(steps)
    before = np.concatenate(([0], total))[ends[:-1]]
    return row, total - before[row], numbers


def _sums(_, frequencies: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block's documents: the numbers of pieces at the dictionary's places."""
    _, place, number = _pairs(list(answers["pieces"]))
    pieces = np.zeros(int(place.max() if len(place) else 0) + 1, np.int64)
    pieces[place] = number
    row, place, times = _pairs(list(frequencies["times"]))
    sums = np.bincount(row, pieces[place] * (times + 1), len(frequencies)).astype(np.int64)
    return pd.DataFrame(
        {
            "doc_id": frequencies["doc_id"].astype("Int64"),
            "n_bytes": frequencies["n_bytes"].astype("int64"),
            "n_tokens": frequencies["known"].to_numpy(np.int64) + sums,
        }
    )


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    found = stored(
        documents(docs, id_col, text_col).mapInArrow(
            functools.partial(_frequencies, tokenizer), FREQUENCIES
        ), "frequencies"
    )
    asked = found.where("pretoken IS NOT NULL").select("block", "place", "pretoken")
    answers = (
        asked.repartition("pretoken")
        .sortWithinPartitions("pretoken")
        .mapInArrow(functools.partial(_answers, tokenizer), "home long, pieces binary")
    )
    kept = found.where("pretoken IS NULL").select("block", "doc_id", "n_bytes", "known", "times")
    return (
        kept.groupBy("block")
        .cogroup(answers.groupBy("home"))
        .applyInPandas(_sums, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
