"""Broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest dimension table we broadcast explicitly (bytes); beyond it joins shuffle.
DEFAULT_BROADCAST_LIMIT = 256 * 1024 * 1024


def broadcast_limit(spark) -> int:
    return int(spark.conf.get("oddone.broadcast.maxBytes", str(DEFAULT_BROADCAST_LIMIT)))


def checked_broadcast(small: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """``broadcast(small)`` when ``n_rows * row_bytes`` fits the limit, else ``small`` unchanged
    (the join then shuffles on its keys)."""
    if n_rows * row_bytes <= broadcast_limit(small.sparkSession):
        return F.broadcast(small)
    return small
