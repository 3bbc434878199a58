"""Spots, polygons, images and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import scale_factor, scale_value
from .joins import DataError
from .order import positions, running_sum


def spot_index(points: DataFrame) -> DataFrame:
    """Distinct (x, y) with a dense index by x, then y: places within a column of the grid follow the columns before."""
    spots = points.select("x", "y").distinct()
    columns = running_sum(spots.groupBy("x").agg(F.count("*").alias("n")), "n", "x")
    inside = spots.withColumn("__k", F.row_number().over(Window.partitionBy("x").orderBy("y")))
    out = inside.join(columns, "x").withColumn("spot", (F.col("running") - F.col("n") + F.col("__k") - 1).cast("long"))
    return out.select("x", "y", "spot", F.format_string("spot_%d_%d", "x", "y").alias("spot_id"))


def spot_counts(molecules: DataFrame, count: str) -> DataFrame:
    """Molecules summed per spot and gene; duplicates merge before the index is joined."""
    sums = molecules.groupBy("x", "y", "gene").agg(F.sum(count).cast("long").alias("value"))
    return sums.join(spot_index(sums), ["x", "y"]).select("spot", "spot_id", "gene", "value")


def checksum(announced: DataFrame, count: str, rows: DataFrame) -> DataFrame:
    """Whether announced counts sum to the rows that are stored."""
    a = announced.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("announced"), F.lit(1).alias("__k"))
    b = rows.agg(F.count("*").cast("long").alias("stored"), F.lit(1).alias("__k"))
    return a.join(b, "__k").drop("__k").withColumn("consistent", F.col("announced") == F.col("stored"))


def centroids(polygons: DataFrame) -> DataFrame:
    return polygons.groupBy("cell").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def polygon_offsets(polygons: DataFrame) -> DataFrame:
    n = polygons.groupBy("cell").agg(F.count("*").cast("long").alias("vertices"))
    return running_sum(n, "vertices", "cell", out="offset_end").withColumn("offset_end", F.col("offset_end").cast("long"))


def technology(points: DataFrame, has_images: bool = False) -> DataFrame:
    """Guesses the technology from images, the regularity of the grid and the number of points."""
    t = points.agg(F.count("*").cast("long").alias("n"), F.count_distinct("x").cast("long").alias("nx"), F.count_distinct("y").cast("long").alias("ny"))
    grid = (F.col("nx") < F.col("n") / 2) & (F.col("ny") < F.col("n") / 2)
    return t.withColumn("technology", F.when(F.lit(has_images) | grid, "Visium").when(F.col("n") > 50000, "HighDensitySpatial").otherwise("Generic"))


def normalise_pixels(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Values over 1 are scaled by 255, 65535 or the maximum, and clipped to [0, 1]."""
    top = pixels.agg(F.max(value).alias("m")).first().m
    k = 1.0 if top is None or top <= 1 else 255.0 if top <= 255 else 65535.0 if top <= 65535 else top
    return pixels.withColumn(value, F.least(F.greatest(F.col(value) / k, F.lit(0.0)), F.lit(1.0)))


def image_axes(shape: list[int], names: list[str] | None = None) -> dict[str, int]:
    """Which axes of an image are h, w and c (absent: one channel). Names settle it; else four and five axes begin with
    time, and the channels are a first axis of up to four, else a last one of up to four, else the first. Further axes
    (time, depth) are read at 0."""
    if names and len(names) == len(shape) and {"y", "x"} <= {*names}:
        return {"h": names.index("y"), "w": names.index("x")} | ({"c": names.index("c")} if "c" in names else {})
    n = len(shape)
    if n == 2:
        return {"h": 0, "w": 1}
    if n not in (3, 4, 5):
        raise DataError(f"an image of {n} axes")
    c, h, w = {3: (0, 1, 2), 4: (1, 2, 3), 5: (1, 3, 4)}[n]
    if shape[c] > 4 and shape[w] <= 4:
        return {"h": c, "w": h, "c": w}
    return {"c": c, "h": h, "w": w}


def to_hwc(flat: DataFrame, shape: list[int], names: list[str] | None = None) -> DataFrame:
    """Pixels (pos: flat place in row-major order) with h, w, c and their channels-last place hwc; time and depth at 0."""
    axes = image_axes(shape, names)
    place, step = {}, 1
    for k in reversed(range(len(shape))):
        place[k], step = F.floor(F.col("pos") / step) % shape[k], step * shape[k]
    rest = [k for k in range(len(shape)) if k not in axes.values()]
    out = flat
    for k in rest:
        out = out.filter(place[k] == 0)
    c = place[axes["c"]] if "c" in axes else F.lit(0)
    out = out.withColumns({"h": place[axes["h"]].cast("long"), "w": place[axes["w"]].cast("long"), "c": c.cast("long")})
    return out.withColumn("hwc", (F.col("h") * shape[axes["w"]] + F.col("w")) * (shape[axes["c"]] if "c" in axes else 1) + F.col("c"))


def chw_to_hwc(flat: DataFrame, c: int, h: int, w: int) -> DataFrame:
    """Flat positions of a channels-first image with their coordinates and channels-last positions."""
    rest = F.col("pos") % (h * w)
    out = flat.withColumns({"c": F.floor(F.col("pos") / (h * w)), "h": F.floor(rest / w), "w": rest % w})
    return out.withColumn("hwc", (F.col("h") * w + F.col("w")) * c + F.col("c"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels per tile of size x size and how many zeros pad it."""
    t = pixels.groupBy(F.floor(F.col("h") / size).alias("tile_y"), F.floor(F.col("w") / size).alias("tile_x")).agg(F.count("*").cast("long").alias("pixels"))
    return t.withColumn("padding", F.lit(size * size).cast("long") - F.col("pixels"))


def scale_factors(factors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Stored names and values; a missing low-resolution factor falls back to the high-resolution one, within ``by`` (a
    library)."""
    out = factors.select(*by, scale_factor(F.col("name")).alias("stored"), scale_value(F.col("name"), F.col("value")).alias("value"))
    low = out.filter("stored = 'tissue_lowres_scalef'").select(*by, "stored")
    fallback = out.filter("stored = 'tissue_hires_scalef'").withColumn("stored", F.lit("tissue_lowres_scalef"))
    return out.unionByName(fallback.join(low, [*by, "stored"], "left_anti"))


#: Rows of a column that are joined with the column in one task.
HOT_COLUMN = 4096


def overlap_graph(coo: DataFrame) -> DataFrame:
    """Edges (i, j, w) between rows that share columns: w sums the smaller value of each shared column. A column of many
    rows is dealt out: each part of it meets the whole column in a task of its own, and sums are made there first."""
    parts = coo.groupBy("var_idx").agg(F.ceil(F.count("*") / HOT_COLUMN).cast("int").alias("parts"))
    sized = coo.join(parts, "var_idx")
    a = sized.select(F.col("obs_idx").alias("i"), "var_idx", F.pmod(F.xxhash64("obs_idx"), F.col("parts")).cast("int").alias("part"), F.col("value").alias("x"))
    b = sized.select(F.col("obs_idx").alias("j"), "var_idx", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("value").alias("y"))
    return a.join(b, ["var_idx", "part"]).filter("i <> j").groupBy("i", "j").agg(F.sum(F.least("x", "y")).cast("long").alias("w"))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each row, ties by the smaller neighbour."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
    return edges.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("i", "rank", "j", "w")


def polygons_from_runs(coords: DataFrame, offsets: DataFrame) -> DataFrame:
    """Flat vertices (pos, x, y) with the cell whose run [begin, end) holds them."""
    runs = offsets.select("cell", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("pos"))
    return coords.join(runs, "pos").join(positions(runs, "pos", ("cell",), "vertex"), ["cell", "pos"]).select("cell", "vertex", "x", "y")
