"""Matrix layouts: COO, compressed rows or columns, dense.

coo: obs_idx, var_idx, value (no zeros). packed: major index, ptr (end offset), nnz, indices, vals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sum


def pack(coo: DataFrame, majors: DataFrame, major: str = "obs_idx", minor: str = "var_idx") -> DataFrame:
    """Compressed rows (or columns) in the order of their minor index, with empty ones; a row a major index. Pointers come
    from counts, so the arrays are made once. (A column that may outgrow an array: see pack_segments().)"""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(minor).alias("i"), F.col("value").alias("v"))))
    rows = coo.groupBy(major).agg(pairs.alias("p"))
    counts = majors.select(major).join(coo.groupBy(major).agg(F.count("*").alias("nnz")), major, "left").withColumn("nnz", F.coalesce("nnz", F.lit(0).cast("long")))
    ends = running_sum(counts, "nnz", major, out="ptr")
    out = ends.join(rows, major, "left").withColumn("p", F.coalesce("p", F.array().cast(rows.schema["p"].dataType)))
    return out.select(major, "nnz", F.col("p.i").alias("indices"), F.col("p.v").alias("vals"), "ptr")


def pack_segments(coo: DataFrame, major: str = "obs_idx", minor: str = "var_idx", size: int = 1 << 20) -> DataFrame:
    """Compressed rows (or columns) in segments: a segment holds a major index's entries of ``size`` minor indices in a row,
    so no array outgrows that, however full a column is. ptr is where the segment ends among all entries; empty rows
    have no segment."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(minor).alias("i"), F.col("value").alias("v"))))
    rows = coo.groupBy(major, F.floor(F.col(minor) / size).alias("part")).agg(pairs.alias("p"))
    rows = rows.select(major, "part", F.size("p").cast("long").alias("nnz"), F.col("p.i").alias("indices"), F.col("p.v").alias("vals"))
    counts = coo.groupBy(major).agg(F.count("*").alias("__n"))
    starts = running_sum(counts, "__n", major, out="__end").select(major, (F.col("__end") - F.col("__n")).alias("__start"))
    inside = F.sum("nnz").over(Window.partitionBy(major).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(starts, major).withColumn("ptr", F.col("__start") + F.col("__inside")).drop("__inside", "__start")


def unpack(packed: DataFrame, major: str = "obs_idx", minor: str = "var_idx") -> DataFrame:
    z = packed.select(major, F.explode(F.arrays_zip("indices", "vals")).alias("z"))
    return z.select(major, F.col("z.indices").alias(minor), F.col("z.vals").alias("value"))


def expand_runs(runs: DataFrame, start: str, count: str, out: str = "pos") -> DataFrame:
    """A row for each position of a run [start, start + count)."""
    return runs.filter(F.col(count) > 0).withColumn(out, F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1)))


def transpose(coo: DataFrame) -> DataFrame:
    """Swaps the axes; no data moves."""
    return coo.select(F.col("var_idx").alias("obs_idx"), F.col("obs_idx").alias("var_idx"), "value")


def dense_tile(coo: DataFrame, rows: tuple[int, int], cols: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """All cells of a tile [begin, end) x [begin, end) of a matrix of that shape, zeros included."""
    spark = coo.sparkSession
    rows, cols = (rows[0], min(rows[1], shape[0])), (cols[0], min(cols[1], shape[1]))
    if rows[0] >= rows[1] or cols[0] >= cols[1]:
        return coo.limit(0)
    grid = spark.range(*rows).withColumnRenamed("id", "obs_idx").withColumn("var_idx", F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1] - 1)).cast("array<bigint>")))
    inside = coo.filter(F.col("obs_idx").between(rows[0], rows[1] - 1) & F.col("var_idx").between(cols[0], cols[1] - 1))
    return grid.join(inside, ["obs_idx", "var_idx"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def drop_zeros(dense: DataFrame) -> DataFrame:
    return dense.filter("value <> 0")


def log_normalise(coo: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p of counts per row, scaled; rounded to 6 places."""
    sums = coo.groupBy("obs_idx").agg(F.sum("value").alias("total"))
    return coo.join(sums, "obs_idx").select("obs_idx", "var_idx", F.round(F.log1p(F.col("value") / F.col("total") * scale), 6).alias("value"))
