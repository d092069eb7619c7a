"""Broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast may have.
SMALL = 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has no more rows than most, which a count of as many tells; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
