"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt into blocks. A block sorts its rows once per dimension; a query reads
the lists from the end where its component gains most, a stretch of every list at a
time (``STEP`` entries, then as many again as were read), scores the rows it meets for
the first time in full, and stops as soon as the best score an unread row could have
(the sum over dimensions of the query's component times the value last read) is below
its k-th score, or no row is left. The answers of all blocks are merged by score and id.

Queries and candidates are dealt out in groups and blocks of bounded size, so a task
never holds more than one of each; the queries are a stated share of the rows.

Defined cases: vectors that are null or hold null or non-finite components take no part;
missing components at the end count as 0, so an empty vector scores 0; ties go to the
smaller id; repeated candidate rows are candidates each; rows with the query's id are
never its candidates; a repeated query id is answered once, for its smallest vector;
rows with a null id take no part; an empty table gives no rows; other columns are not
read. Scores are 64-bit integers.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.llm.common import ship, stored

K = 10
BLOCK_ROWS = 4096
GROUP_QUERIES = 4096
STEP = 32

FOUND = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(vector: Column) -> Column:
    """``floor(1024 * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(1024 * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, bad)


class SortedLists:
    """Rows of a block and, per dimension, their places in ascending order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best ``(score, -id)`` of this block, best first."""
        best: list[tuple[int, int]] = []
        n, used = len(self.ids), np.flatnonzero(query)
        weights = query[used]
        if not len(used):
            return self._merge(best, np.zeros(n, np.int64), np.arange(n), own, k)
        rising, falling = used[weights < 0], used[weights > 0]
        seen, unread, at = np.zeros(n, bool), n, 0
        while unread:
            upto = min(n, max(STEP, 2 * at))
            met = np.zeros(n, bool)
            # lists are read from the end where the product is largest
            met[self.order[at:upto, rising]] = True
            met[self.order[n - upto : n - at, falling]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            unread -= len(new)
            best = self._merge(best, self.rows[new] @ query, new, own, k)
            bound = int(self.rows[self.order[upto - 1, rising], rising] @ query[rising])
            bound += int(self.rows[self.order[n - upto, falling], falling] @ query[falling])
            if len(best) == k and best[-1][0] > bound:
                break
            at = upto
        return best

    def _merge(self, best, scores, places, own, k):
        if len(best) == k:
            good = scores >= best[-1][0]
            scores, places = scores[good], places[good]
        ids = self.ids[places]
        # the query's own rows take no room below
        others = ids != own
        scores, ids = scores[others], ids[others]
        if len(ids) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        found = best + [(int(s), -int(i)) for s, i in zip(scores, ids)]
        return sorted(found, reverse=True)[:k]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = np.zeros((len(column), width), np.int64)
    for i, values in enumerate(column.to_pylist()):
        rows[i, : len(values)] = values
    return rows


def _width(table: pa.Table) -> int:
    return max((len(v) for v in table.column("vector").to_pylist()), default=0)


def _answer(k: int, queries: pa.Table, candidates: pa.Table) -> pa.Table:
    width = max(_width(queries), _width(candidates))
    held = SortedLists(candidates.column("vec_id").to_numpy(), _matrix(candidates.column("vector"), width))
    rows: list[tuple[int, int, int]] = []
    asked = _matrix(queries.column("vector"), width)
    for query_id, query in zip(queries.column("query_id").to_pylist(), asked):
        rows += [(query_id, -i, score) for score, i in held.top(query, query_id, k)]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query row."""
    ship(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        scaled(F.col(vector_col)).alias("vector"),
        is_query.alias("asks"),
    )
    rows = stored(rows, "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, groups = -(-sizes["n"] // BLOCK_ROWS) or 1, -(-sizes["q"] // GROUP_QUERIES) or 1

    def dealt(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(parts)), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    candidates = rows.select("vec_id", "vector", dealt("vec_id", blocks).alias("block")).select(
        "*", every(groups).alias("group")
    )
    queries = (
        rows.where("asks")
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min("vector").alias("vector"))
        .select("*", dealt("query_id", groups).alias("group"))
        .select("query_id", "vector", "group", every(blocks).alias("block"))
    )
    found = (
        queries.groupBy("block", "group")
        .cogroup(candidates.groupBy("block", "group"))
        .applyInArrow(functools.partial(_answer, k), FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
