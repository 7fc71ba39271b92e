"""Joins with a side whose size is looked at before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(rows: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Marks ``rows`` for a broadcast only if they are ``max_rows`` at most; else the join shuffles."""
    return F.broadcast(rows) if rows.limit(max_rows + 1).count() <= max_rows else rows
