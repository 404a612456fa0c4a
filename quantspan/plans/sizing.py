"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint while it has at most ``max_rows`` rows, else unchanged.

    The count stops at ``max_rows + 1``. Callers pass a table or something cheap to count.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
