"""Importance resampling of documents towards a target by hashed n-gram features.

A text is lower-cased (A-Z), its separators collapse to single spaces, and an overlapped
regex scan with look-arounds at the words' boundaries finds, at every word, the ends of the
runs of one, two and three words that begin there. Runs are hashed by CRC-32 to one of
10,000 buckets; a run's CRC goes on from the one of the run that is a word shorter, so that
no feature becomes a string of its own.

One pass scans the documents and stores, per document, its buckets, two bytes each. Counts
of all documents and of the target follow as sums over tasks of 10,000 numbers; the gain
of a bucket compares the two. A document's weight is the sum of the gains of its
features. Adding Gumbel noise from a hash of the id and taking the highest scores draws
without replacement in proportion to the weights' exponentials.

Defined cases: null and empty texts have no words, no features and weight 0; repeated rows
are documents of their own, and rows with equal score and id are ranked by weight, then
features; a null id hashes as an empty string and comes after all others of its score; an
empty target or empty documents count as sums of 0; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ship, stored
from roomledger.plans.numbering import positions

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Lower-cases A-Z; all but 0-9, a-z and the bytes of multi-byte characters become spaces.
_FOLDED = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
#: At a word's begin: the word, the blank and second word, the blank and third word.
GRAMS = regex.compile(rb"(?<![^ ])([^ ]++)(?:( [^ ]++)( [^ ]++)?+)?+(?![^ ])")
_SCANNED = "doc_id long, n_words long, buckets binary"
_SCANNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])
_SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def hashes(text: bytes) -> tuple[list[int], int]:
    """CRC-32 of every run of one to three words, and the number of words."""
    line = b" ".join(text.translate(_FOLDED).split())
    found: list[int] = []
    words, add, crc32 = 0, found.append, zlib.crc32
    for words, m in enumerate(GRAMS.finditer(line, overlapped=True), 1):
        crc = crc32(m[1])
        add(crc)
        if (second := m[2]) is not None:
            crc = crc32(second, crc)
            add(crc)
            if (third := m[3]) is not None:
                add(crc32(third, crc))
    return found, words


def _scanned(buckets: int, batches):
    for batch in batches:
        words, kept = [], []
        for text in batch.column(1):
            found, n = hashes(text.as_buffer().to_pybytes())
            words.append(n)
            kept.append((np.array(found, np.uint32) % np.uint32(buckets)).astype("<u2").tobytes())
        columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCANNED_ARROW)


def scanned(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, buckets)`` with two bytes a feature; ``buckets`` is at most 65,536."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    return narrow.mapInArrow(partial(_scanned, buckets), _SCANNED)


def _counted(buckets: int, batches):
    sums = np.zeros(buckets, np.int64)
    for batch in batches:
        for value in batch.column(0):
            sums += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
    there = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], ["bucket", "n"])


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket of all rows; one row per bucket and task is exchanged, and one
    per bucket reaches the driver."""
    parts = features.select("buckets").mapInArrow(partial(_counted, buckets), "bucket int, n long")
    sums = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def gains(have: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the add-one shares in the target and in the documents."""
    s_all, t_all = float(have.sum() + len(have)), float(target.sum() + len(have))
    ratios = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(have.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, least: int, seed: int, batches):
    for batch in batches:
        ids, words = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        found = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(2)]
        weight = np.array([int(gain[f].sum()) for f in found], np.int64)
        score = weight + np.array([noise(i, seed) for i in ids], np.int64)
        sizes = np.array([len(f) for f in found], np.int64)
        columns = [batch.column(0), *map(pa.array, (sizes, weight, score, words >= least))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "score", "eligible"])


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    ``rank`` counts from 1 the ``percent`` of the documents of at least ``least_words``
    words that are drawn, by falling score, and is null for all others.
    """
    features = stored(scanned(docs, id_col, text_col, buckets), "features")
    aims = scanned(target.withColumn("_none", F.lit(None).cast("bigint")), "_none", target_text_col, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aims, buckets))
    scored = features.mapInArrow(partial(_scored, gain, least_words, seed), _SCORED)
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features")]
    placed = positions(scored, order, "_position")
    drawn = features.where(F.col("n_words") >= least_words).count() * percent // 100
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("_position") <= drawn, F.col("_position")).alias("rank"),
    )
