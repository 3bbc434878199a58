"""Selections and alignments by position or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions, running_sum


class DataError(ValueError):
    """Input that breaks a rule of the data model."""


def slice_rows(df: DataFrame, idx: str, picks: list[int] | list[bool], size: int | None = None) -> DataFrame:
    """Rows in the order of ``picks``, repeats kept; new_idx is the place in picks. A list of booleans is a mask over
    ``size`` rows. The list of distinct indices is pushed to the scan before the join restores order and repeats."""
    if picks and all(isinstance(p, bool) for p in picks):
        if size is not None and len(picks) != size:
            raise DataError(f"the mask has {len(picks)} entries for {size} rows")
        picks = [k for k, p in enumerate(picks) if p]
    if any(p < 0 or (size is not None and p >= size) for p in picks):
        raise DataError(f"index out of range in {[p for p in picks if p < 0 or (size is not None and p >= size)][:5]}")
    wanted = df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(picks)], "new_idx long, __idx long")
    near = df.filter(F.col(idx).isin(sorted(set(picks)))) if len(picks) <= 10_000 else df
    return near.join(wanted, F.col(idx) == F.col("__idx")).drop("__idx", idx)


def select_items(df: DataFrame, key: str, names: list[str] | None, order: str | None = None) -> DataFrame:
    """None keeps all; an empty list nothing; else those that exist, in the order of names (pos), items of one name by the
    unique whole-number column ``order``."""
    if names is None:
        return df
    place = F.array_position(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), F.col(key))
    present = df.drop("pos").filter(place > 0).withColumn("__at", place)
    if order:
        inside = positions(present, order, ("__at",), "__in")
        sizes = present.groupBy("__at").agg(F.count("*").alias("__n"))  # a row a name
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        present = inside.join(sizes.withColumn("__start", before), "__at").withColumn("pos", (F.col("__start") + F.col("__in")).cast("long"))
    else:
        present = positions(present, "__at", out="pos")
    return present.select("pos", *[c for c in df.columns if c != "pos"])


def valid_rows(coo: DataFrame, axis: DataFrame, idx: str, valid: Column) -> DataFrame:
    """Keeps valid rows of an axis and numbers them anew."""
    kept = positions(axis.filter(valid).select(idx), idx, out="new_idx")
    return coo.join(kept, idx).drop(idx)


def value_filter(df: DataFrame, predicate: str, columns: list[str]) -> DataFrame:
    """A predicate and a projection, both of which reach the scan."""
    return df.filter(predicate).select(columns)


def semi(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def membership(df: DataFrame, members: DataFrame, key: str, flag: str, count: str) -> DataFrame:
    """A flag for each row that is a member, and how many members there are."""
    marked = members.select(F.col(key).alias("__k"), F.lit(True).alias("__in")).distinct()
    total = members.select(key).distinct().agg(F.count("*").alias("n")).first().n
    out = df.drop(flag).join(marked, F.col(key) == F.col("__k"), "left")
    return out.withColumn(flag, F.coalesce("__in", F.lit(False))).withColumn(count, F.lit(total).cast("long")).drop("__k", "__in")


def common(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in other; order and columns stay."""
    return semi(df, other, key)


def match_first(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with the first row of right by ``order`` for each key; unmatched rows get nulls."""
    rest = [c for c in right.columns if c not in (key, order)]
    first = right.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*rest), order).alias("__f"))
    return left.join(first, F.col(key) == F.col("__k"), "left").select(*left.columns, *[F.col(f"__f.{c}").alias(c) for c in rest])


def overlay(under: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """All rows and columns of both; where both have a value, over's counts."""
    shared = [c for c in under.columns if c in over.columns and c != key]
    named = over.withColumnsRenamed({c: f"__over_{c}" for c in shared})
    out = under.join(named, key, "full")
    return out.withColumns({c: F.coalesce(f"__over_{c}", c) for c in shared}).drop(*[f"__over_{c}" for c in shared])


def pad(axis: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A row for each entry of the axis; nulls where rows has none."""
    return axis.join(rows, key, "left")


def append(old: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """old with the rows of new whose key it lacks (or, overwriting, new with the rest of old)."""
    first, second = (new, old) if overwrite else (old, new)
    return first.unionByName(anti(second, first, key), allowMissingColumns=True)


def zip_positions(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs rows by position."""
    return left.join(right, F.col(a) == F.col(b)).drop(b)


def threshold(left: DataFrame, right: DataFrame, key: str, share: float) -> DataFrame:
    """All rows matched: reordered; more than ``share`` matched: filled with nulls; else the columns stay null."""
    n = left.count()
    hit = semi(left, right, key).count()
    how = "matched" if hit == n else "filled" if hit > share * n else "none"
    out = left.join(right if how != "none" else right.limit(0), key, "left")
    return out.withColumn("how", F.lit(how))


def by_stored_index(df: DataFrame, index: str, tie: str, out: str) -> DataFrame:
    """Rows with their place by a stored index (ties by a unique whole number), which goes."""
    ranked = df.groupBy(index).agg(F.count("*").alias("__n"))
    ranked = running_sum(ranked, "__n", index, out="__end")
    inside = positions(df, tie, (index,), "__in")
    return inside.join(ranked, index).withColumn(out, (F.col("__end") - F.col("__n") + F.col("__in")).cast("long")).drop(index, "__in", "__n", "__end")
