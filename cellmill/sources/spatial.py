"""Spatial pieces of a container: images, scale factors, boundaries and molecules, below uns/spatial/<library>.

Tables: images (library, image, h, w, c, value), scalefactors (library, name, value), boundaries (library, boundary, type,
cell_idx, cell, vertex, x, y), molecules (library, set, pos, x, y, gene). Executors read ranges of the stored arrays;
writing streams each table once, in order, through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import image_axes, polygons_from_runs
from . import zarr_store as Z

SCHEMAS = {
    "images": "library string, image string, h long, w long, c long, value double", "scalefactors": "library string, name string, value double",
    "boundaries": "library string, boundary string, type string, cell_idx long, cell string, vertex long, x double, y double", "molecules": "library string, set string, pos long, x double, y double, gene string",
}
_PARTS = ("images", "scalefactors", "segmentation", "molecules")
#: Paths below uns that are tables here.
HELD = re.compile(rf"spatial/[^/]+/({'|'.join(_PARTS)})(/|$)")
STEP = 1 << 16
_DICT = {"encoding-type": "dict", "encoding-version": "0.1.0"}


def ranges(spark: SparkSession, tree, columns: dict[str, tuple[str, int | None, str]], n: int, step: int = STEP) -> DataFrame:
    """pos and columns (name -> key of an array, column of it or None, Spark type), read in ranges of rows."""
    kinds = {"double": pa.float64(), "string": pa.string(), "long": pa.int64()}

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in part.column(0).to_pylist():
                end = min(n, begin + step)
                out = [pa.array(np.arange(begin, end))]
                for key, column, kind in columns.values():
                    values = tree.array(key).read(begin, end)
                    values = values if column is None else values[:, column]
                    out.append(pa.array([str(v) for v in values], kinds[kind]) if kind == "string" else pa.array(values.astype("f8" if kind == "double" else "i8"), kinds[kind]))
                yield pa.record_batch(out, ["pos", *columns])

    return spark.range(0, n, step).mapInArrow(read, ", ".join(["pos long", *[f"{c} {k}" for c, (_, _, k) in columns.items()]]))


def pixels(spark: SparkSession, tree, key: str, names: list[str] | None = None, rows: int = 64) -> DataFrame:
    """h, w, c, value of an image of two to five axes, read in ranges of its first axis (the one of rows, where that is
    first). Values over 1 are left as they are."""
    array = tree.array(key)
    shape = list(array.shape)
    axes = image_axes(shape, names)
    rest = [k for k in range(len(shape)) if k not in axes.values()]
    first = next(k for k in range(len(shape)) if k == 0)
    n = 1 if first in rest else shape[0]
    step = rows if axes["h"] == 0 else 1

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in part.column(0).to_pylist():
                block = np.asarray(tree.array(key).read(begin, min(n, begin + step)), float)
                block = block[tuple(slice(0, 1) if k in rest else slice(None) for k in range(block.ndim))]
                at = np.indices(block.shape)
                at[0] += begin
                out = [at[axes[x]].reshape(-1) if x in axes else np.zeros(block.size, np.int64) for x in "hwc"]
                for a in range(0, block.size, STEP):
                    yield pa.record_batch([pa.array(x[a : a + STEP].astype(np.int64)) for x in out] + [pa.array(block.reshape(-1)[a : a + STEP])], ["h", "w", "c", "value"])

    return spark.range(0, n, step).mapInArrow(read, "h long, w long, c long, value double")


def read_spatial(spark: SparkSession, tree, top: str = "uns/spatial") -> dict[str, DataFrame]:
    """The tables of all libraries, libraries in the order of their names; none where the file has no such part."""
    found: dict[str, list[DataFrame]] = {}
    factors = []
    add = lambda table, df, *names: found.setdefault(table, []).append(df.select(*[F.lit(v).alias(k) for k, v in names], "*"))
    for lib in tree.children(top):
        at = f"{top}/{lib}"
        for name in tree.children(f"{at}/scalefactors"):
            if tree.kind(f"{at}/scalefactors/{name}") == "array":
                factors.append((lib, name, float(np.asarray(tree.array(f"{at}/scalefactors/{name}").read()).reshape(-1)[0])))
        for name in tree.children(f"{at}/images"):
            add("images", pixels(spark, tree, f"{at}/images/{name}", ["y", "x", "c"] if len(tree.array(f"{at}/images/{name}").shape) == 3 else None), ("library", lib), ("image", name))
        for name in tree.children(f"{at}/segmentation"):
            own = f"{at}/segmentation/{name}"
            kind = tree.attrs(own).get("type", "Segmentation")
            n, m = tree.array(f"{own}/cell_ids").shape[0], tree.array(f"{own}/coords").shape[0]
            coords = ranges(spark, tree, {"x": (f"{own}/coords", 0, "double"), "y": (f"{own}/coords", 1, "double")}, m)
            cells = ranges(spark, tree, {"cell": (f"{own}/cell_ids", None, "string")}, n).withColumnRenamed("pos", "cell_idx")
            if kind == "Segmentation":
                ends = ranges(spark, tree, {"begin": (f"{own}/polygon_offsets", None, "long")}, n + 1)
                runs = ends.join(ends.select((F.col("pos") - 1).alias("pos"), F.col("begin").alias("end")), "pos").select(F.col("pos").alias("cell"), "begin", "end").filter("end > begin")
                drawn = polygons_from_runs(coords, runs).withColumnRenamed("cell", "cell_idx")
            else:
                drawn = coords.select(F.col("pos").alias("cell_idx"), F.lit(0).cast("long").alias("vertex"), "x", "y")
            add("boundaries", drawn.join(cells, "cell_idx").select("cell_idx", "cell", "vertex", "x", "y"), ("library", lib), ("boundary", name), ("type", kind))
        for name in tree.children(f"{at}/molecules"):
            own = f"{at}/molecules/{name}"
            add("molecules", ranges(spark, tree, {"x": (f"{own}/x", None, "double"), "y": (f"{own}/y", None, "double"), "gene": (f"{own}/gene", None, "string")}, tree.array(f"{own}/x").shape[0]), ("library", lib), ("set", name))
    out = {}
    for table, parts in found.items():
        out[table] = parts[0]
        for p in parts[1:]:
            out[table] = out[table].unionByName(p)
    if factors:
        out["scalefactors"] = spark.createDataFrame(factors, SCHEMAS["scalefactors"])
    return out


def write_spatial(tables: dict[str, DataFrame], group: Callable[[str, dict], None], put: Callable, grow: Callable, batches: Callable, top: str = "uns/spatial") -> None:
    """grow(key, dtype, tail, attributes) -> what takes parts of a dataset; batches(df, *order) -> its rows in order."""
    if not any(t in tables for t in SCHEMAS):
        return
    group(top, _DICT)
    known: set[str] = set()

    def folder(key: str, attributes: dict | None = None) -> None:
        for k in range(top.count("/") + 1, key.count("/") + 1):
            above = "/".join(key.split("/")[: k + 1])
            if above not in known:
                group(above, _DICT)
                known.add(above)
        if attributes:
            group(key, attributes)

    if "scalefactors" in tables:
        for r in tables["scalefactors"].orderBy("library", "name").toLocalIterator():
            folder(f"{top}/{r.library}/scalefactors")
            put(f"{top}/{r.library}/scalefactors/{r.name}", np.array(r.value), {})
    if "images" in tables:
        sizes = {(r.library, r.image): (r.h + 1, r.w + 1, r.c + 1) for r in tables["images"].groupBy("library", "image").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("c").alias("c")).collect()}  # a row an image
        for key, at, values in _runs(batches(tables["images"].select("library", "image", "h", "w", "c", "value"), "library", "image", "h", "w", "c"), 2):
            h, w, c = sizes[key]
            if at == 0:
                folder(f"{top}/{key[0]}/images")
                out, done = grow(f"{top}/{key[0]}/images/{key[1]}", "<f8", (w, c), {}), 0
            if values is None:
                out.add(np.zeros(h * w * c - done))
                out.close()
                continue
            flat = (values[0] * w + values[1]) * c + values[2]
            block = np.zeros(int(flat[-1]) + 1 - done)
            block[flat - done] = values[3]
            out.add(block)
            done += len(block)
    if "boundaries" in tables:
        for (lib, name, kind), at, values in _runs(batches(tables["boundaries"].select("library", "boundary", "type", "cell_idx", "vertex", "cell", "x", "y"), "library", "boundary", "type", "cell_idx", "vertex"), 3):
            own = f"{top}/{lib}/segmentation/{name}"
            if at == 0:
                folder(own, {"type": kind})
                coords, ids = grow(f"{own}/coords", "<f8", (2,), {}), grow(f"{own}/cell_ids", "string", (), {})
                ends = grow(f"{own}/polygon_offsets", "<i8", (), {}) if kind == "Segmentation" else None
                last, count = None, 0
            if values is None:
                if ends is not None:
                    ends.add(np.array([count]))
                for d in (coords, ids, ends):
                    if d is not None:
                        d.close()
                continue
            cells, names = values[0], values[2]
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            new[0] = cells[0] != last
            ids.add([names[k] for k in np.flatnonzero(new)])
            if ends is not None:
                ends.add(count + np.flatnonzero(new))
            coords.add(np.stack([values[3], values[4]], axis=1))
            last, count = cells[-1], count + len(cells)
    if "molecules" in tables:
        for (lib, name), at, values in _runs(batches(tables["molecules"].select("library", "set", "pos", "x", "y", "gene"), "library", "set", "pos"), 2):
            own = f"{top}/{lib}/molecules/{name}"
            if at == 0:
                folder(own)
                open_ = [grow(f"{own}/{k}", t, (), {}) for k, t in (("x", "<f8"), ("y", "<f8"), ("gene", "string"))]
            for d, part in zip(open_, (None,) * 3 if values is None else values[1:], strict=True):
                d.close() if part is None else d.add(part)


def _runs(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, list | None]]:
    """Sorted batches by their first columns: (key, rows before, the other columns) for each piece, and None for the last
    column list when a key has ended."""
    at, count = None, 0
    for part in parts:
        names = list(zip(*[part.column(k).to_pylist() for k in range(keys)], strict=True))
        values = [part.column(k).to_pylist() if pa.types.is_string(part.schema.types[k]) else np.asarray(part.column(k)) for k in range(keys, part.num_columns)]
        cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if names[a] != at:
                if at is not None:
                    yield at, count, None
                at, count = names[a], 0
            yield at, count, [v[a:b] for v in values]
            count += b - a
    if at is not None:
        yield at, max(1, count), None


def image_coordinates(spots: DataFrame, factors: DataFrame, library: str, image: str = "lowres") -> DataFrame:
    """obs_idx, x, y of spots on an image: their full-size coordinates (obsm rows of spatial) by its scale factor; a
    missing low-resolution factor falls back to the high-resolution one."""
    own = factors.filter(F.col("library") == library)
    names = [f"tissue_{image}_scalef", "tissue_hires_scalef"]
    best = own.filter(F.col("name").isin(names)).agg(F.min_by("value", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))).alias("k"))
    return spots.crossJoin(F.broadcast(best)).select("obs_idx", (F.element_at("vec", 1) * F.coalesce("k", F.lit(1.0))).alias("x"), (F.element_at("vec", 2) * F.coalesce("k", F.lit(1.0))).alias("y"))


class ZarrGrowing:
    """A dataset of a store whose rows come a part at a time; its chunks are written as they fill."""

    CHUNK = 1 << 16

    def __init__(self, store: Z.Store, how: tuple, key: str, dtype: str, tail: tuple[int, ...], attributes: dict):
        self.store, self.how, self.key, self.dtype, self.tail, self.attributes = store, how, key, dtype, tuple(tail), attributes
        self.width = int(np.prod(tail)) if tail else 1
        self.rows = max(1, self.CHUNK // self.width)
        self.held, self.size, self.chunk, self.count = [], 0, 0, 0

    def add(self, part) -> None:
        part = list(part) if self.dtype == "string" else np.asarray(part).reshape(-1)
        self.held.append(part)
        self.size += len(part)
        while self.size >= self.rows * self.width:
            self._write(self.rows)

    def _write(self, rows: int) -> None:
        whole = [x for p in self.held for x in p] if self.dtype == "string" else np.concatenate(self.held)
        n = rows * self.width
        values = whole[:n] if self.dtype == "string" else whole[:n].reshape(rows, *self.tail)
        Z.write_chunk(self.store, self.key, (self.chunk, *[0] * len(self.tail)), values, [self.rows, *self.tail], self.dtype, *self.how)
        self.held, self.size = [whole[n:]], self.size - n
        self.chunk, self.count = self.chunk + 1, self.count + rows

    def close(self) -> int:
        if self.size:
            self._write(self.size // self.width)
        Z.write_meta(self.store, self.key, [self.count, *self.tail], [self.rows, *self.tail], self.dtype, *self.how, self.attributes)
        return self.count
