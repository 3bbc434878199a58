"""Vendor bundles: CosMx CSV, Xenium Parquet, and Stereo-seq run lengths as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import DataError
from ..operators.spatial import spot_index
from .container import Container, names_in
from .registry import COSMX_FILES, XENIUM_FILES


#: Fixed value: how the file of outlines ends.
POLYGONS = "-polygons.csv"
#: Names that a dense index is split at, and names sampled for one of them.
SPLITS, SAMPLED = 256, 16


def _found(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, str]:
    here = names_in(spark, path)
    return {n: f"{path}/{h}" for n in names for h in here if h.endswith(n)}


def _index(df: DataFrame, name: str, idx: str) -> DataFrame:
    """A dense index by name (names are unique): ranks within ranges between sampled names, then where each begins."""
    every = max(1, df.count() // (SPLITS * SAMPLED))
    # about SPLITS * SAMPLED names
    some = sorted(r[0] for r in df.select(name).filter(F.pmod(F.xxhash64(name), F.lit(every)) == 0).collect())[SAMPLED::SAMPLED]
    at = F.size(F.filter(F.array(*[F.lit(x) for x in some]).cast("array<string>"), lambda x: x <= F.col(name)))
    ranged = df.withColumn("__range", at)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # SPLITS rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(name))).join(sizes.withColumn("__start", before), "__range")
    return ranked.withColumn(idx, (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__range", "__n", "__rank", "__start")


def read_cosmx(spark: SparkSession, path: str) -> Container:
    """Counts, metadata, centroids, outlines and molecules of a bundle; cells are those in all of counts, metadata and, if
    there are outlines, these."""
    files = _found(spark, path, COSMX_FILES)
    if len(files) < 2 or COSMX_FILES[0] not in files or COSMX_FILES[1] not in files:
        raise DataError(f"{path} is no CosMx bundle: it has {sorted(files)}")
    read = lambda n: spark.read.csv(files[n], header=True, inferSchema=True)
    cell = F.concat_ws("_", F.col("cell_ID").cast("string"), F.col("fov").cast("string"))
    counts = read(COSMX_FILES[0]).withColumn("obs_id", cell)
    meta = read(COSMX_FILES[1]).withColumn("obs_id", cell)
    meta = meta.withColumnsRenamed({c: c.replace(".", "_") for c in meta.columns})
    genes = [c for c in counts.columns if c not in ("fov", "cell_ID", "obs_id")]
    both = meta.join(counts.select("obs_id"), "obs_id", "left_semi")
    drawn = [f"{path}/{n}" for n in names_in(spark, path) if n.endswith(POLYGONS)]
    if drawn:
        polygons = spark.read.csv(drawn, header=True, inferSchema=True)
        ident = "cellID" if "cellID" in polygons.columns else "cell_ID"
        polygons = polygons.withColumn("obs_id", F.concat_ws("_", F.col(ident).cast("string"), F.col("fov").cast("string")))
        both = both.join(polygons.select("obs_id").distinct(), "obs_id", "left_semi")
    obs = _index(both, "obs_id", "obs_idx")
    obs = obs.select("obs_idx", "obs_id", *[c for c in obs.columns if c not in ("obs_idx", "obs_id")])
    var = spark.createDataFrame(list(enumerate(genes)), "var_idx long, var_id string")
    long = counts.select("obs_id", *[F.col(f"`{g}`").cast("double").alias(g) for g in genes]).unpivot(["obs_id"], genes, "var_id", "value").filter("value <> 0")
    matrix = long.join(obs.select("obs_idx", "obs_id"), "obs_id").join(var, "var_id").select(F.lit("X").alias("layer"), "obs_idx", "var_idx", "value")
    c = Container.of(spark, (obs.count(), len(genes)), {"format": "cosmx"}, obs=obs, var=var, matrix=matrix)
    c.tables["boundaries"] = _centroids(obs, "CenterX_global_px", "CenterY_global_px")
    if drawn:
        c.tables["boundaries"] = c.tables["boundaries"].unionByName(_polygons(polygons, obs, "x_global_px", "y_global_px"))
    if COSMX_FILES[3] in files:
        c.tables["molecules"] = _molecules(read(COSMX_FILES[3]), "target", "x_global_px", "y_global_px")
    return c


def _centroids(obs: DataFrame, x: str, y: str) -> DataFrame:
    return obs.select(F.lit("fov").alias("library"), F.lit("centroids").alias("boundary"), F.lit("Centroids").alias("type"), F.col("obs_idx").alias("cell_idx"), F.col("obs_id").alias("cell"), F.lit(0).cast("long").alias("vertex"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def _polygons(rows: DataFrame, obs: DataFrame, x: str, y: str) -> DataFrame:
    """rows: obs_id and vertices in the order of the file."""
    at = rows.withColumn("__at", F.monotonically_increasing_id())
    vertex = (F.row_number().over(Window.partitionBy("obs_id").orderBy("__at")) - 1).cast("long")
    drawn = at.withColumn("vertex", vertex).select("obs_id", "vertex", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).join(obs.select("obs_idx", "obs_id"), "obs_id")
    return drawn.select(F.lit("fov").alias("library"), F.lit("segmentation").alias("boundary"), F.lit("Segmentation").alias("type"), F.col("obs_idx").alias("cell_idx"), F.col("obs_id").alias("cell"), "vertex", "x", "y")


def _molecules(rows: DataFrame, gene: str, x: str, y: str) -> DataFrame:
    return rows.select(F.lit("fov").alias("library"), F.lit("molecules").alias("set"), F.monotonically_increasing_id().alias("pos"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(gene).cast("string").alias("gene"))


def read_xenium(spark: SparkSession, path: str, min_quality: float = 20.0) -> Container:
    """Counts from the matrix file if the bundle has one, else from transcripts of at least min_quality (the vendor's own
    limit) that are assigned to a cell; cells, boundaries and molecules as tables."""
    files = _found(spark, path, XENIUM_FILES)
    if "cells.parquet" not in files or "transcripts.parquet" not in files:
        raise DataError(f"{path} is no Xenium bundle: it has {sorted(files)}")
    cells, found = spark.read.parquet(files["cells.parquet"]), spark.read.parquet(files["transcripts.parquet"])
    obs = _index(cells.withColumn("obs_id", F.col("cell_id").cast("string")), "obs_id", "obs_idx")
    if "cell_feature_matrix.h5" in files:
        sums, var = _tenx(spark, files["cell_feature_matrix.h5"])
    else:
        good = found.filter(F.col("qv") >= min_quality) if "qv" in found.columns else found
        good = good.withColumn("obs_id", F.col("cell_id").cast("string")).filter(~F.col("obs_id").isin("UNASSIGNED", "-1"))
        sums = good.groupBy("obs_id", F.col("feature_name").cast("string").alias("var_id")).agg(F.count("*").cast("double").alias("value"))
        var = _index(sums.select("var_id").distinct(), "var_id", "var_idx").select("var_idx", "var_id")
    matrix = sums.join(obs.select("obs_idx", "obs_id"), "obs_id").join(var, "var_id").select(F.lit("X").alias("layer"), "obs_idx", "var_idx", "value")
    c = Container.of(spark, (obs.count(), var.count()), {"format": "xenium"}, obs=obs.select("obs_idx", "obs_id", *[x for x in cells.columns if x != "obs_id"]), var=var, matrix=matrix)
    c.tables["molecules"] = _molecules(found, "feature_name", "x_location", "y_location")
    parts = [_centroids(c.obs, "x_centroid", "y_centroid")] if {"x_centroid", "y_centroid"} <= {*cells.columns} else []
    if "cell_boundaries.parquet" in files:
        edges = spark.read.parquet(files["cell_boundaries.parquet"]).withColumn("obs_id", F.col("cell_id").cast("string"))
        parts.append(_polygons(edges, c.obs, "vertex_x", "vertex_y"))
    if parts:
        c.tables["boundaries"] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return c


def _tenx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(obs_id, var_id, value) and var of a matrix file: features x cells by columns, under the group matrix."""
    from .hdf5 import Tree

    tree = Tree(path)
    n, step = tree.array("matrix/barcodes").shape[0], 1024
    names = [str(x) for x in tree.array("matrix/features/name").read().tolist()]

    def read(parts):
        import numpy as np
        import pandas as pd

        for part in parts:
            for begin in part["id"]:
                ptr = tree.array("matrix/indptr").read(int(begin), int(begin) + step + 1).astype("int64")
                cells = tree.array("matrix/barcodes").read(int(begin), int(begin) + step)
                at = tree.array("matrix/indices").read(int(ptr[0]), int(ptr[-1]))
                yield pd.DataFrame({"obs_id": np.repeat(cells, np.diff(ptr)), "var_idx": at.astype("int64"), "value": tree.array("matrix/data").read(int(ptr[0]), int(ptr[-1])).astype(float)})

    var = spark.createDataFrame(list(enumerate(names)), "var_idx long, var_id string")
    entries = spark.range(0, n, step).mapInPandas(read, "obs_id string, var_idx long, value double")
    return entries.join(var, "var_idx").select("obs_id", "var_id", "value"), var


def square_bins(genes: DataFrame, expression: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stereo-seq square bins. genes: gene, offset, count (runs of expression rows); expression: pos, x, y, n. Returns
    spots and (spot, gene, value); counts of one spot and gene are summed. Runs must cover all rows."""
    announced, stored = genes.agg(F.sum("count")).first()[0] or 0, expression.count()
    if announced != stored:
        raise DataError(f"genes announce {announced} expression rows, the file has {stored}")
    runs = genes.filter(F.col("count") > 0).select("gene", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("count") - 1)).alias("pos"))
    sums = expression.join(runs, "pos").groupBy("x", "y", "gene").agg(F.sum("n").cast("long").alias("value"))
    spots = spot_index(sums)
    return spots, sums.join(spots, ["x", "y"]).select("spot", "gene", "value")


def cell_bins(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Stereo-seq cell bins. cells: cell, offset, gene_count; expression: pos, gene, n."""
    announced, stored = cells.agg(F.sum("gene_count")).first()[0] or 0, expression.count()
    if announced != stored:
        raise DataError(f"cells announce {announced} expression rows, the file has {stored}")
    runs = cells.filter("gene_count > 0").select("cell", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("gene_count") - 1)).alias("pos"))
    return expression.join(runs, "pos").groupBy("cell", "gene").agg(F.sum("n").cast("long").alias("value"))
