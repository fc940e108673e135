"""Substring search of guests through a stored table of character triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.sources.layout import parts_of, write_clustered

#: The columns that guest searches read.
SEARCHED = ("first_name", "last_name", "email", "phone")
GRAM = 3
#: Characters with a meaning of their own in a LIKE pattern.
PATTERN_CHARACTERS = "%_\\"
_SCHEMA = "gram string, field string, id bigint"


def _grams(text) -> F.Column:
    """Distinct runs of ``GRAM`` characters of a lower-cased text."""
    last = F.length(text) - GRAM + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


def search_postings(customers: DataFrame) -> DataFrame:
    """``(gram, field, id)`` for every triple of characters in a searched column."""
    each = customers.select("id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), F.lower(name).alias("text")) for name in SEARCHED
    ])).alias("f"))
    return each.where("f.text IS NOT NULL").select(
        F.explode(_grams(F.col("f.text"))).alias("gram"), F.col("f.field").alias("field"), "id"
    )


def write_search_index(customers: DataFrame, path: str, files: int | None = None) -> None:
    """Postings in the order of their triples, so that a search opens the few row groups
    whose range holds one of its triples. Triples that very many guests share are spread
    over as many files as their rows need: ids order them further.

    A guest becomes some fifty postings, so guests are spread before, over more tasks than
    the few that read their file, and postings go to as many files if none are given."""
    parts = parts_of(customers.sparkSession)
    guests = customers.select("id", *SEARCHED).repartition(parts)
    write_clustered(search_postings(guests), path, ["gram", "field", "id"], files or parts)


def grams_of(spark: SparkSession, text: str) -> list[str] | None:
    """Triples of a search text; None where only a scan can tell: shorter texts, and those
    with characters that stand for others."""
    if any(c in text for c in PATTERN_CHARACTERS):
        return None
    # lower-cased where the pattern is, since case may depend on the neighbours
    low = spark.range(1).select(F.lower(F.lit(f"%{text}%"))).first()[0][1:-1]
    found = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    return found or None


def candidates(
    customers: DataFrame, text: str, fields: tuple[str, ...], index: str | None
) -> DataFrame:
    """The guests that may hold ``text`` in one of ``fields``: every true match is among them.

    A guest has to have all triples of the text in one column; the postings of these few
    triples are counted per guest and column, and whoever lacks one leaves. Without an
    index, or where it cannot tell, these are all guests.
    """
    spark = customers.sparkSession
    grams = grams_of(spark, text) if index else None
    if grams is None:
        return customers
    postings = spark.read.schema(_SCHEMA).parquet(index)
    met = postings.where(F.col("gram").isin(grams) & F.col("field").isin(*fields))
    complete = met.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return customers.join(complete.select("id").distinct(), "id", "left_semi")
