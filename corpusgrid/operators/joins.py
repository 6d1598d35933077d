"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row limit under which a dimension-like table is broadcast explicitly.
DEFAULT_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count proves it has at most ``max_rows`` rows.

    Above the limit the plain DataFrame is returned and the join stays a
    shuffle join (AQE may still convert it at runtime from measured sizes,
    and splits skewed partitions of the big side).
    """
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df
