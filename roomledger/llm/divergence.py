"""Divergence of the sources of each language, by a three-dimensional partition.

Documents become counts of (language, source, term) inside their tasks; the terms that
enough documents of a language use are kept. A source's smoothed share of each kept term,
in billionths, is compared with that of every other source of the language.

The comparison is a cube of group block x group block x term block. A language's sources
and kept terms are dealt into blocks by hash; a slice (group block, term block) is sent to
every cell that needs it, a cell holds two slices and adds up the distances of its pairs
over its own terms, and the partial sums are reduced along the term axis. A cell's size is
bounded whatever the number of sources and terms, and no term, however common, has more
rows than there are sources. Terms that a source lacks have one and the same share, so
slices carry only what occurs, and the number of kept terms.

Defined cases: null text, language and source are empty strings; a language without kept
terms has divergences of 0 and no term rows; a source that is alone in its language has no
pair rows; repeated rows are documents of their own; an empty table gives no rows; columns
other than the three are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.llm.common import ship, stored

LEAST_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Sources and kept terms of a block, on average.
GROUPS_PER_BLOCK = 32
TERMS_PER_BLOCK = 4096
#: A task's counts are sent on at so many entries.
ENTRIES = 400_000

#: Lower-cases A-Z; all but letters and the bytes of multi-byte characters become spaces.
_FOLDED = bytes(
    b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_COUNTS = "lang string, source string, term string, n long, docs long"
_DISTANCES = pa.schema([(n, pa.string()) for n in ("lang", "source", "item")] + [("value", pa.int64())])
_COUNTS_ARROW = pa.schema(
    [(n, pa.string()) for n in ("lang", "source", "term")] + [("n", pa.int64()), ("docs", pa.int64())]
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _batch(lang: str, source: str, n: Counter, docs: Counter) -> pa.RecordBatch:
    # a row without a term stands for the group itself
    terms = [None, *(t.decode("utf-8", "replace") for t in n)]
    columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs.__getitem__, n)]]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _COUNTS_ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_COUNTS_ARROW)


def _counted(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms_of(text.as_buffer().to_pybytes())
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in held.values()) >= ENTRIES:
            yield from (_batch(*key, *pair) for key, pair in held.items())
            held = {}
    yield from (_batch(*key, *pair) for key, pair in held.items())


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, source, term, n, docs)``, and a row with a null term for every group."""
    ship(docs.sparkSession)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    narrow = docs.select(plain[0].alias("lang"), plain[1].alias("source"), plain[2].cast("binary").alias("text"))
    return (
        narrow.mapInArrow(_counted, _COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(UNIT * (count + smoothing) / (total + smoothing * terms)), without overflow."""
    wide = (count.cast("decimal(20,0)") + smoothing) * F.lit(UNIT).cast("decimal(10,0)")
    rest = total + smoothing * terms
    return 1 + F.call_function("div", wide, rest.cast("decimal(20,0)"))


def _cell(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
    """Distances of the pairs of a cell, over its terms.

    Rows without a term give a group's share of absent terms and the cell's kept terms.
    """
    first, second = key[1].as_py(), key[2].as_py()
    # in one order in every cell of the term axis, so that a pair has one direction
    groups = cell.filter(pc.is_null(cell["term"])).sort_by("source")
    used = cell.filter(pc.is_valid(cell["term"]))
    sources, absent = groups["source"].to_pylist(), groups["p"].to_numpy()
    column = used["term"].combine_chunks().dictionary_encode()
    row = pc.index_in(used["source"], groups["source"].combine_chunks()).to_numpy()
    shares = np.repeat(absent[:, None], len(column.dictionary), axis=1)
    shares[row, column.indices.to_numpy()] = used["p"].to_numpy()
    lacking = groups["kept"][0].as_py() - len(column.dictionary)
    block = groups["block"].to_numpy()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    found: list[tuple[str, str, int]] = []
    for i in left:
        over = right[right > i] if first == second else right
        value = np.abs(shares[over] - shares[i]).sum(axis=1) + lacking * np.abs(absent[over] - absent[i])
        found += [(sources[i], sources[j], v) for j, v in zip(over, value.tolist())]
    columns = [[r[k] for r in found] for k in range(3)]
    return pa.table([[key[0].as_py()] * len(found), *columns], schema=_DISTANCES)


def _block(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks).cast("int")


def divergences(groups: DataFrame, shares: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language.

    ``groups`` (lang, source, absent, block, blocks, term_blocks), ``shares`` (lang, source,
    term, p, block, blocks, term_block) and ``kept`` (lang, term_block, kept).
    """
    axis = F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block")
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "block", "blocks", axis)
    heads = heads.join(kept, ["lang", "term_block"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    body = shares.select("lang", "source", "term", "p", "block", "blocks", "term_block", F.lit(0).alias("kept"))
    slices = heads.select(*body.columns).unionByName(body)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = slices.select("*", other).select(
        "lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "term_block", "source", "term", "p", "block", "kept",
    )
    parts = cells.groupBy("lang", "first", "second", "term_block").applyInArrow(
        _cell, "lang string, source string, item string, value long"
    )
    half = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return half.unionByName(turned)


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    groups_per_block: int = GROUPS_PER_BLOCK,
    terms_per_block: int = TERMS_PER_BLOCK,
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank from 1.

    ``pair`` rows give the distance to each other source of the language, ``term`` rows the
    ``top_terms`` terms that the source uses most beyond the language's share.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    words = counts.where("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = stored(kept.where(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
    used = words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = counts.where("term IS NULL").select("lang", "source")
    spread = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))

    def blocks(n: str, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")

    about = spread.join(langs, "lang", "left").select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        blocks("sources", groups_per_block).alias("blocks"),
        F.coalesce(blocks("terms", terms_per_block), F.lit(1)).alias("term_blocks"),
    )
    groups = stored(
        named.join(totals, ["lang", "source"], "left").join(about, "lang").select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total", "blocks", "term_blocks",
            F.when(F.col("terms") > 0, share(F.lit(0), F.coalesce("total", F.lit(0)), F.col("terms")))
            .otherwise(0).alias("absent"),
            _block("source", F.col("blocks")).alias("block"),
        ), "groups",
    )
    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "block", "blocks",
        _block("term", F.col("term_blocks")).alias("term_block"),
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    kept_of = kept.join(about.select("lang", "term_blocks"), "lang").groupBy(
        "lang", _block("term", F.col("term_blocks")).alias("term_block")
    ).agg(F.count(F.lit(1)).alias("kept"))
    pairs = divergences(groups, shares, kept_of).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part")
    )
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    number = F.row_number().over(ranked).alias("rank")
    columns = ["lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), number]
    return pairs.select(*columns).unionByName(terms.select(*columns).where(F.col("rank") <= top_terms))
