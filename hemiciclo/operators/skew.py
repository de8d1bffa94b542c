"""Group sizes checked before rows are nested under a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 16 bytes a key: far below the 8 GB a broadcast may hold, small enough for every executor.
BROADCAST_KEYS = 1_000_000


def oversized_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of parts that keep each part near it.

    The count is combined before the shuffle, so a key with most of the rows costs one row a task.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return counted.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("n_parts"))


def small_side(df: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """Hint a broadcast only if a count shows at most ``bound`` rows; else leave the join to AQE,
    which splits skewed sort-merge partitions. ``df`` should be cheap to count: see `settled`."""
    return F.broadcast(df) if df.count() <= bound else df
