"""Positions and prefix sums without a single-task window over all rows.

A global order is split into buckets of consecutive keys: totals of buckets are summed first (a row a bucket), then rows
inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def running_sum(df: DataFrame, value: str, order: str, by: tuple[str, ...] = (), out: str = "running") -> DataFrame:
    """Adds the sum of value over all rows up to this one in the order of the whole-number column ``order``, within ``by``."""
    df = df.withColumn("__bucket", F.floor(F.col(order) / BUCKET))
    keys = [*by, "__bucket"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__inside", inside).join(starts, keys).withColumn(out, F.col("__start") + F.col("__inside")).drop("__bucket", "__sum", "__start", "__inside")


def positions(df: DataFrame, key: str, by: tuple[str, ...] = (), out: str = "idx") -> DataFrame:
    """Adds the 0-based rank of a unique whole-number key, within ``by``."""
    ones = running_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one", key, by, out)
    return ones.withColumn(out, (F.col(out) - 1).cast("long")).drop("__one")


def islands(df: DataFrame, value: str, order: str, by: tuple[str, ...] = (), out: str = "island") -> DataFrame:
    """Numbers runs of one value in the order of a dense whole-number column, from 1: a run begins where the row before
    differs. Rows before are found by a join on order - 1, so no window spans all rows."""
    keys = [*by, "__at"]
    before = df.select(*by, (F.col(order) + 1).alias("__at"), F.col(value).alias("__was"), F.lit(True).alias("__there"))
    marked = df.withColumn("__at", F.col(order)).join(before, keys, "left")
    begins = (F.col("__there").isNull() | ~F.col(value).eqNullSafe(F.col("__was"))).cast("long")
    return running_sum(marked.withColumn("__new", begins), "__new", order, by, out).drop("__new", "__was", "__at", "__there")


def chunk_of(idx: Column, size: int) -> Column:
    return F.floor(idx / size).cast("long")
