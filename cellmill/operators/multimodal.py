"""Modalities: names, index maps, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import assay_to_modality, reduction_name
from ..functions.names import make_unique
from .order import positions


def reduction_stem(key: str) -> str:
    return key.removeprefix("X_")


def reduction_plan(obsm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Embeddings (pos, key) to reductions, within ``by`` (a file): coordinates are left out, X_ is stripped. The first
    claimant of a name gets it, later ones take their key; names that still meet get a suffix, as make_unique() gives it."""
    clean = obsm.withColumn("__c", reduction_name(F.col("key"))).filter("__c <> 'spatial'")
    first = F.row_number().over(Window.partitionBy(*by, "__c").orderBy("pos")) == 1
    raw = clean.withColumn("__r", F.when(first, F.col("__c")).otherwise(F.col("key")))
    return make_unique(raw, "__r", "pos", "reduction", by=by).drop("__c", "__r")


def reduction_names(keys: list[str]) -> list[str]:
    """reduction_plan() for the keys of one file."""
    raw, claimed = [], set()
    for k in keys:
        raw.append(k if reduction_stem(k) in claimed else reduction_stem(k))
        claimed.add(reduction_stem(k))
    out, taken, count = [], set(raw), {}
    for name in raw:
        if name not in count:
            count[name] = 0
            out.append(name)
            continue
        while (new := f"{name}.{count[name] + 1}") in taken:
            count[name] += 1
        count[name] += 1
        taken.add(new)
        out.append(new)
    return out


def modalities(assays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A modality's name for each assay (pos, assay), within ``by`` (a file). Where several assays have one name, SCT beside
    RNA is sct, later protein assays carry their own name too, other later ones take their own name. What still meets gets
    a suffix."""
    plain = assays.withColumn("__m", assay_to_modality(F.col("assay")))
    same = Window.partitionBy(*by, "__m")
    first = F.row_number().over(same.orderBy("pos")) == 1
    both = F.max(F.col("assay") == "RNA").over(same) & F.max(F.col("assay") == "SCT").over(same) & (F.col("__m") == "rna")
    own = F.lower("assay")
    named = F.when(both & (F.col("assay") == "SCT"), "sct").when(both | first, F.col("__m")).when(F.col("__m") == "prot", F.concat(F.lit("prot_"), own)).otherwise(own)
    return make_unique(plain.withColumn("__name", named), "__name", "pos", "modality", by=by).drop("__m", "__name")


def concat_names(parts: DataFrame) -> DataFrame:
    """modality, ord, idx, name of all modalities, with a global index by (ord, idx); names that several modalities
    have carry their modality."""
    sizes = parts.groupBy("modality", "ord").agg((F.max("idx") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a modality
    starts = sizes.select("modality", before.alias("__start"))
    clash = parts.groupBy("name").agg(F.count_distinct("modality").alias("k")).filter("k > 1").select(F.col("name").alias("__n"))
    out = parts.join(starts, "modality").join(clash, F.col("name") == F.col("__n"), "left")
    named = F.when(F.col("__n").isNotNull(), F.concat("modality", F.lit(":"), "name")).otherwise(F.col("name"))
    return out.withColumns({"global_idx": (F.col("__start") + F.col("idx")).cast("long"), "global_name": named}).drop("__start", "__n")


def var_map(named: DataFrame) -> DataFrame:
    """For each modality and global index its local index, -1 outside the modality's block."""
    mods = [r.modality for r in named.select("modality").distinct().orderBy("modality").collect()]
    each = named.select("modality", "global_idx", "idx").withColumn("m", F.explode(F.array(*[F.lit(m) for m in mods])))
    return each.select(F.col("m").alias("modality"), "global_idx", F.when(F.col("m") == F.col("modality"), F.col("idx")).otherwise(-1).cast("long").alias("local_idx"))


def obs_map(obs: DataFrame, mods: list[str]) -> DataFrame:
    """All modalities have the same cells in the same order."""
    return obs.select(F.explode(F.array(*[F.lit(m) for m in mods])).alias("modality"), F.col("obs_idx").alias("global_idx"), F.col("obs_idx").alias("local_idx"))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that are in both, only left or only right."""
    both = a.intersect(b).withColumn("side", F.lit("both"))
    left = a.subtract(b).withColumn("side", F.lit("left"))
    return both.unionByName(left).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def validate(cells: DataFrame, mods: dict[str, DataFrame]) -> DataFrame:
    """For each modality how many cells it has, lacks, and holds at another place."""
    out = None
    for name, m in mods.items():
        own = m.select(F.col("obs_id").alias("__id"), F.col("obs_idx").alias("__at"))
        row = cells.join(own, F.col("obs_id") == F.col("__id"), "left").agg(
            F.count("__id").cast("long").alias("cells"), F.count_if(F.col("__id").isNull()).cast("long").alias("missing"), F.count_if(F.col("__at") != F.col("obs_idx")).cast("long").alias("moved")
        )
        row = row.select(F.lit(name).alias("modality"), "cells", "missing", "moved", ((F.col("missing") == 0) & (F.col("moved") == 0)).alias("valid"))
        out = row if out is None else out.unionByName(row)
    return out


def libraries(obs: DataFrame, col: str) -> DataFrame:
    return obs.groupBy(F.col(col).alias("library")).agg(F.count("*").cast("long").alias("cells"), F.min("obs_idx").alias("first_idx"))


def split_libraries(df: DataFrame, col: str) -> dict[str, DataFrame]:
    """One lazy DataFrame per library."""
    return {r[0]: df.filter(F.col(col).eqNullSafe(F.lit(r[0]))) for r in df.select(col).distinct().orderBy(col).collect()}


def item_union(lists: DataFrame, group: str, items: str, order: str) -> DataFrame:
    """Distinct items of several lists of a group, with their place by first mention (list, then place in it)."""
    each = lists.select(group, order, F.posexplode(items).alias("__at", "item"))
    first = each.groupBy(group, "item").agg(F.min(F.struct(order, "__at")).alias("__first"))
    return first.withColumn("pos", (F.row_number().over(Window.partitionBy(group).orderBy("__first")) - 1).cast("long")).drop("__first")


def primary_image(images: DataFrame, by: tuple[str, ...], name: str = "image") -> DataFrame:
    """Images in the order of their names; the first one of each ``by`` is the primary one."""
    rank = (F.row_number().over(Window.partitionBy(*by).orderBy(name)) - 1).cast("long")
    return images.withColumn("rank", rank).withColumn("is_primary", F.col("rank") == 0)


def default_first(assays: DataFrame, by: tuple[str, ...], default: str = "is_default") -> DataFrame:
    """Assays in the order of a listing: the default one first, then by place."""
    rank = (F.row_number().over(Window.partitionBy(*by).orderBy(F.col(default).desc(), "pos")) - 1).cast("long")
    return assays.withColumn("shown", rank)
