"""Key sets and lookups that stay cheap when one key owns many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_set(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """Distinct non-null keys.

    Duplicates are folded before the shuffle, so a hot key leaves each map
    task as one row, and a semi or anti join on the result cannot be skewed
    by this side.
    """
    keys = df.where(F.col(name).isNotNull()).select(F.col(name).alias(alias or name))
    return keys.distinct()


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Only the given columns, as ``new_name=old_name``."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])
