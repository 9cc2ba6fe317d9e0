"""Order-dependent columns without a task that holds a whole contig.

Rows are cut into ranges of (key, order) of about equal size.  Each range is
solved by a window of its own, and what a range needs from the ones before it
(a running sum or maximum, the next value) comes from a table with one row for
each range and key.  As a key's rows lie in neighbouring ranges, only the first
key of a range has anything carried over, so at most one row for each range is
joined back: that table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from ..sources.shared import stored

FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def ranged(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with ``pid``, the number of their range. Written, so that all later steps see the same ranges."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *key, *order).withColumn("pid", F.spark_partition_id()), "ranges")


def running(df: DataFrame, key: list[str], order: list[str], value: Column, how: str, name: str, inclusive: bool = True) -> DataFrame:
    """A running sum, max or min of value within a key. df: of ranged()."""
    fold = FOLDS[how]
    held = df.withColumn("own_value", value)
    before = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*key, "pid").agg(fold("own_value").alias("own"))
    carried = totals.select(*key, "pid", fold("own").over(before).alias("carry")).filter("carry is not null")
    w = Window.partitionBy("pid", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = null_safe(held.withColumn("local", fold("own_value").over(w)), F.broadcast(carried), [*key, "pid"], "left")
    both = {"sum": F.coalesce(F.col("local") + F.col("carry"), "local", "carry"), "max": F.greatest("local", "carry"), "min": F.least("local", "carry")}[how]
    return out.withColumn(name, both).drop("own_value", "local", "carry")


def beside(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, after: bool = True) -> DataFrame:
    """The value of the next row (or the one before) within a key. df: of ranged()."""
    held = df.withColumn("own_value", value)
    w = Window.partitionBy("pid", *key).orderBy(*order)
    # one row of each range and key: the one that its neighbour sees
    place = F.struct(*order)
    edge = F.min_by("own_value", place) if after else F.max_by("own_value", place)
    by_range = Window.partitionBy(*key).orderBy("pid")
    totals = held.groupBy(*key, "pid").agg(F.struct(edge.alias("v")).alias("own"))
    carry = (F.lead if after else F.lag)("own").over(by_range)
    carried = totals.select(*key, "pid", carry.alias("carry")).filter("carry is not null")
    local = (F.lead if after else F.lag)(F.struct("own_value")).over(w)
    out = null_safe(held.withColumn("local", local), F.broadcast(carried), [*key, "pid"], "left")
    return out.withColumn(name, F.when(F.col("local").isNotNull(), F.col("local.own_value")).otherwise(F.col("carry.v"))).drop("own_value", "local", "carry")


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in a global order; no task sorts more than one range. order must tell all rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("pid").agg(F.count("*").alias("size"))  # a row for each range
    before = sizes.select("pid", F.coalesce(F.sum("size").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    return held.join(F.broadcast(before), "pid").withColumn(name, F.col("before") + local).drop("pid", "before")
