"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a narrow side (a key and a few small columns) that every executor can hold.
BROADCAST_ROWS = 500_000
# Narrow rows that a task sorts or groups at a time.
TASK_ROWS = 1_000_000


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Count `df` (one narrow job, one number back) and compare with the bound."""
    return df.count() <= (BROADCAST_ROWS if max_rows is None else max_rows)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint when its counted size allows it, else unchanged (shuffle join)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """`df` by the hash of the columns, in as many parts as its counted rows take; few rows as the session has it."""
    parts = -(-rows // TASK_ROWS)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*columns)
    return df.repartition(parts, *columns)
