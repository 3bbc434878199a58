"""Integrity checks and resolution rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparsity(coo: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    n, p = obs.count(), var.count()
    t = coo.agg(F.count("*").cast("long").alias("nnz"))
    cells = float(n) * p
    return t.select(F.lit(n).cast("long").alias("n_obs"), F.lit(p).cast("long").alias("n_var"), "nnz", F.round(1 - F.col("nnz") / F.lit(cells), 9).alias("sparsity") if cells else F.lit(None).cast("double").alias("sparsity"))


def pointer_check(packed: DataFrame) -> DataFrame:
    """The last pointer must be the number of stored values."""
    t = packed.agg(F.coalesce(F.sum(F.size("vals")), F.lit(0)).cast("long").alias("nnz"), F.coalesce(F.max("ptr"), F.lit(0)).cast("long").alias("last_ptr"))
    return t.withColumn("consistent", F.col("nnz") == F.col("last_ptr"))


def inferred_dims(coo: DataFrame) -> DataFrame:
    return coo.agg((F.max("obs_idx") + 1).alias("n_rows"), (F.max("var_idx") + 1).alias("n_cols"))


def as_flag(value: Column, kind: str) -> Column:
    """A stored highly_variable column as a flag: a text is true if it is 'True', a number if it isn't 0 (null for NaN)."""
    if kind == "string":
        return value == "True"
    return value if kind == "boolean" else F.when(~F.isnan(value.cast("double")), value != 0)


def stdev_of(variances: Column) -> Column:
    """Standard deviations of a vector of variances."""
    return F.transform(variances, lambda v: F.sqrt(v))


def counts_source(manifest: DataFrame) -> DataFrame:
    """Where counts are: a stamp that names a present path, else layers/counts, raw/X, X. manifest: file, path, value."""
    paths = manifest.groupBy("file").agg(F.collect_set(F.when(F.col("path") != "stamp", F.col("path"))).alias("p"), F.max(F.when(F.col("path") == "stamp", F.col("value"))).alias("s"))
    has = lambda x: F.array_contains("p", x)
    stamp = F.when(F.col("s").isNotNull() & F.array_contains("p", F.col("s")), F.col("s"))
    return paths.select("file", F.coalesce(stamp, F.when(has("layers/counts"), "layers/counts").when(has("raw/X"), "raw/X").otherwise("X")).alias("counts_from"))


def counts_place(stamp: str | None, layer: bool, raw: bool) -> str:
    """counts_source() for one file: its stamp, and whether it has layers/counts and raw/X."""
    there = {"layers/counts": layer, "raw/X": raw, "X": True}
    return stamp if there.get(stamp or "") else "layers/counts" if layer else "raw/X" if raw else "X"


def counts_convention(x: DataFrame, raw: DataFrame | None = None, counts: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Matrices to the layers counts and data: from layers/counts, from raw (features in common), or from X for both."""
    named = lambda m, layer: m.select(F.lit(layer).alias("layer"), "obs_idx", "var_idx", "value")
    if counts is not None:
        first = counts
    elif raw is not None:
        first = raw.join(features.select("var_idx"), "var_idx", "left_semi") if features is not None else raw
    else:
        first = x
    return named(first, "counts").unionByName(named(x, "data"))


def non_integer(values: DataFrame) -> DataFrame:
    t = values.agg(F.count("*").cast("long").alias("n"), F.count_if(F.col("value") != F.floor("value")).cast("long").alias("fractional"))
    return t.withColumn("warn", F.col("fractional") > 0)


def identity(stored: DataFrame, loaded: DataFrame, idx: str, name: str) -> DataFrame:
    """Compares what was read with what was stored, by position; dashes and underscores in names count as one."""
    same = lambda c: F.replace(c, F.lit("_"), F.lit("-"))
    a = stored.select(F.col(idx).alias("__i"), F.col(name).alias("__a"))
    b = loaded.select(F.col(idx).alias("__j"), F.col(name).alias("__b"))
    t = a.join(b, F.col("__i") == F.col("__j"), "full").agg(
        F.count("__i").cast("long").alias("stored"), F.count("__j").cast("long").alias("loaded"),
        F.count_if(same(F.col("__a")) != same(F.col("__b"))).cast("long").alias("renamed"), F.count_if(F.col("__j").isNull() | F.col("__i").isNull()).cast("long").alias("missing"),
    )
    twice = loaded.groupBy(name).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicated"), F.lit(1).alias("__k"))
    out = t.withColumn("__k", F.lit(1)).join(twice, "__k").drop("__k")
    return out.withColumn("identical", (F.col("renamed") + F.col("missing") + F.col("duplicated")) == 0)


def latest(log: DataFrame, name: str, ts: str, tie: str) -> DataFrame:
    """The latest entry of each name."""
    return log.groupBy(F.col(name).alias("name")).agg(F.max(ts).alias("latest"), F.max_by(tie, F.struct(ts, tie)).alias(tie))


def flatten_json(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """A row for each leaf of a JSON column: keep, path (keys and places of lists, joined by slashes), value (as text; {}
    and [] for empty ones). Each round opens one more level of all that is still nested, as VARIANT; the number of rounds
    is the depth of the JSON."""
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0)
    rows = df.select(*keep, F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null")
    leaves = None
    while True:
        text = F.to_json("v")
        nested = kind(F.col("v")).isin("OBJECT", "ARRAY") & ~text.isin("{}", "[]")
        own = rows.filter(~nested).select(*keep, "path", F.when(text.isin("{}", "[]"), text).otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("null"))).alias("value"))
        leaves = own if leaves is None else leaves.unionByName(own)
        rows = rows.filter(nested)
        if rows.isEmpty():
            return leaves
        # an object gives keys, a list places
        opened = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("at", "name", "inner"))
        step = F.coalesce("name", F.col("at").cast("string"))
        rows = opened.select(*keep, F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit("/"), step)).alias("path"), F.col("inner").alias("v"))
