"""Streaming extension: counts from rows as they arrive. All take a streaming or a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_spots(molecules: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Molecules per window of event time, spot and gene; rows later than the watermark are left out once their window
    is closed. Takes a streaming or batch DataFrame with ts, x, y and gene."""
    molecules = molecules.withColumn(ts, F.col(ts).cast("timestamp"))
    return molecules.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "x", "y", "gene").agg(F.count("*").alias("value")).select(F.col("w.start").alias("begin"), "x", "y", "gene", "value")


def arriving_counts(rows: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Entries (obs_idx, var_idx, value) of a matrix that grows: rows of obs_idx and var_idx, once for each event_id within
    the watermark, summed over all that has come."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]).groupBy("obs_idx", "var_idx").agg(F.count("*").alias("value"))


def sessions(rows: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one key's rows without a pause of gap: key, begin, end, rows."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("rows")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "rows")
