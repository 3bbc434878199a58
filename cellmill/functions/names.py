"""Names: sanitising, keys, and making them unique."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitize_column(name: Column) -> Column:
    """Separators become one underscore; one leading and one trailing underscore go; a leading digit gets an X."""
    s = F.regexp_replace(name, r"[/\s,;:\\]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("X"), s)).otherwise(s)


def fix_feature(name: Column) -> Column:
    """Feature names carry dashes where files have underscores."""
    return F.replace(name, F.lit("_"), F.lit("-"))


def image_key(name: Column) -> Column:
    """A key from an image's name: letters, digits and single underscores, ending in one."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("X"), s)).otherwise(s)
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, F.lit("spatial_")).otherwise(F.concat(s, F.lit("_")))


def repeat_number(name: str, order: str, by: tuple[str, ...] = ()) -> Column:
    """0 for the first row with a name, 1 for the next one, ... within ``by``."""
    return (F.row_number().over(Window.partitionBy(*by, name).orderBy(order)) - 1).cast("long")


def make_unique(df: DataFrame, name: str, order: str, out: str = "unique_name", sep: str = ".", by: tuple[str, ...] = ()) -> DataFrame:
    """The first row with a name keeps it, later ones get .1, .2, ... and skip suffixes that are taken by other names;
    within ``by``.

    order: a unique column. A suffixed name may meet a name that stands in the table; such suffixes are counted per
    name and skipped, so one pass is enough: the k-th repeat takes the k-th free suffix.
    """
    n = F.col("__n")
    ranked = df.withColumn("__n", repeat_number(name, order, by))
    # taken suffixes: names in the table of the form <other name><sep><number>
    pattern = rf"^(.*){re.escape(sep)}([1-9][0-9]{{0,8}})$"
    parts, number = F.regexp_extract(F.col(name), pattern, 1), F.regexp_extract(F.col(name), pattern, 2)
    taken = df.select(*[F.col(c).alias(f"__by_{c}") for c in by], parts.alias("__base"), number.alias("__num")).filter("__num <> ''").distinct()
    taken = taken.groupBy(*[f"__by_{c}" for c in by], "__base").agg(F.sort_array(F.collect_list(F.col("__num").cast("long"))).alias("__taken"))
    same = ranked[name] == taken["__base"]
    for c in by:
        same = same & ranked[c].eqNullSafe(taken[f"__by_{c}"])
    joined = ranked.join(taken, same, "left")
    # walking the sorted taken numbers, each one at or below the candidate pushes it up by one
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), n, lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    unique = F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(sep), free))
    return joined.withColumn(out, unique).drop("__n", "__base", "__taken", *[f"__by_{c}" for c in by])


def conflicts(df: DataFrame, name: str) -> DataFrame:
    """Clean names that several names become: clean, n (distinct names), first_name and last_name."""
    return df.select(name).distinct().groupBy(sanitize_column(F.col(name)).alias("clean")).agg(F.count("*").cast("long").alias("n"), F.min(name).alias("first_name"), F.max(name).alias("last_name")).filter("n > 1")


def suffix_duplicates(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Columns that share a sanitised name: later ones get __dup1, __dup2, ..."""
    n = repeat_number(name, order)
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__dup"), n)))


def update_key(key: Column, fallback: Column | None = None) -> Column:
    """A key of letters and digits that ends in one underscore; what has none of these gets the fallback (three random
    letters where none is given)."""
    bare = F.regexp_replace(key, "[^A-Za-z0-9]", "")
    other = fallback if fallback is not None else random_name(3)
    return F.when(key.rlike("^[A-Za-z0-9]+_$"), key).when(bare == "", F.concat(other, F.lit("_"))).otherwise(F.concat(bare, F.lit("_")))


def random_name(length: int = 5, seed: int | None = None) -> Column:
    """Lower-case letters, no two alike."""
    return F.array_join(F.slice(F.shuffle(F.array(*[F.lit(chr(97 + k)) for k in range(26)]), seed), 1, length), "")


def pad_name(name: Column, pos: Column, prefix: str = "index") -> Column:
    """Nameless items are called by their place, from 1."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit(prefix), (pos + 1).cast("string"))).otherwise(name)


#: Metadata keys that a session keeps for itself and no writer stores.
PRIVATE_KEYS = ("__varp__",)


def is_private(key: Column) -> Column:
    """Keys that are private, or those of graphs of features that were kept as metadata, or hidden ones."""
    return key.isin(*PRIVATE_KEYS) | key.rlike(r"^__varp__\.|^\.__")
