"""Size checks in front of every explicit broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a query-side table may have to be broadcast (tens of MB at most for the narrow frames used here).
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Hint a broadcast when the caller has proved the bound, else leave the join to Spark."""
    return F.broadcast(df) if small else df
