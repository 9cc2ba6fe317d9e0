"""Joins whose keys may be null, and joins that broadcast a side only after a check of its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many bytes, by the optimiser's estimate after filters and projections, may be broadcast.
SMALL = 64 << 20


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, null being equal to null. The result has left's columns, then right's other columns."""
    own = {k: f"right_{i}_{k}" for i, k in enumerate(keys)}
    named = right.withColumnsRenamed(own)
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(own[k])) for k in keys))
    return left.join(named, condition, how).drop(*own.values())


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a plan's size: an upper bound where it has no statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = SMALL) -> bool:
    return estimated_bytes(df) <= limit


def if_small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """The table with a broadcast hint if it is small enough, else as it is: the join then shuffles, and adaptive execution splits skewed keys."""
    return F.broadcast(df) if is_small(df, limit) else df
