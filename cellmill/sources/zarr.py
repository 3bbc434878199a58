"""AnnData-Zarr stores: a Spark data source for their components, and a writer in which each task writes whole chunks.

    spark.read.format("anndata_zarr").option("path", p).option("component", "X").load()

Components: X, layers/<name>, raw/X (obs_idx, var_idx, value), obs, var, raw/var, obsm/<key>, varm/<key> (idx, vec),
obsp/<key>, varp/<key> (i, j, w). A partition is a range of rows; filters on the row index drop ranges before anything is fetched.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import Full, Queue
from threading import Event, Thread

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.names import make_unique
from ..operators.joins import DataError
from ..operators.order import running_sum
from ..operators.verify import counts_place
from . import zarr_store as Z
from .container import SCHEMAS, Container, replace_dir
from .hdf5 import slices
from .spatial import HELD, ZarrGrowing, pixels, read_spatial, write_spatial
from .uns import uns_frame, write_uns

#: BUCKET: rows of a matrix whose entries are ordered in one task.
ROWS, CHUNK, BUCKET = 4096, 1 << 16, 512


class ReadWarning(UserWarning):
    """Something in a file was read otherwise than it stands there, or left out."""


class ShapeWarning(ReadWarning):
    pass


class NamesWarning(ReadWarning):
    pass


class CountsWarning(ReadWarning):
    pass



class Sub:
    """A part of a tree under a prefix."""

    def __init__(self, tree, prefix: str):
        self.tree, self.prefix = tree, prefix

    def kind(self, key: str) -> str | None:
        return self.tree.kind(Z.join(self.prefix, key))

    def attrs(self, key: str) -> dict:
        return self.tree.attrs(Z.join(self.prefix, key))

    def children(self, key: str = "") -> list[str]:
        return self.tree.children(Z.join(self.prefix, key))

    def array(self, key: str):
        return self.tree.array(Z.join(self.prefix, key))

    def places(self, key: str) -> dict[str, int] | None:
        return self.tree.places(Z.join(self.prefix, key)) if hasattr(self.tree, "places") else None

    def known(self, key: str, at: int) -> None:
        self.tree.known(Z.join(self.prefix, key), at)


def open_tree(path: str, prefix: str = "", view: str = "", endpoint: str | None = None, cache: str | None = None, **options):
    """A Zarr store or an HDF5 file, what is under a prefix in it, or a view of it: all answer kind, attrs, children and
    array."""
    if path.lower().endswith((".h5ad", ".h5mu", ".h5seurat", ".loom", ".gef", ".h5")):
        from .hdf5 import Tree

        tree = Tree(path)
    else:
        tree = Z.open_store(path, endpoint, cache)
    if view:
        from .views import VIEWS

        return VIEWS[view](tree, **options)
    return Sub(tree, prefix) if prefix else tree


#: Options that open_tree() takes.
_OPENING = ("prefix", "view", "assay", "genes", "cells", "endpoint", "cache")


def _open(options: dict):
    return open_tree(options["path"], **{k: v for k in _OPENING if (v := options.get(k)) is not None})


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def frame_columns(store: Z.Store, key: str) -> list[str]:
    a = store.attrs(key)
    index = a.get("_index", "_index")
    return [c for c in a.get("column-order", [c for c in store.children(key) if c != "__categories"]) if c not in (index, "_index", "index")]


def index_of(store: Z.Store, key: str) -> Z.Array | None:
    for name in ("_index", "index", store.attrs(key).get("_index", "_index")):
        if store.kind(Z.join(key, name)) == "array":
            return store.array(Z.join(key, name))
    return None


def axis_length(store: Z.Store, top: str) -> int | None:
    """Entries of obs or var, by its index or its first column."""
    if (index := index_of(store, top)) is not None:
        return index.shape[0]
    for c in frame_columns(store, top):
        key = Z.join(top, c)
        return store.array(key if store.kind(key) == "array" else Z.join(key, "codes" if store.kind(Z.join(key, "codes")) else "values")).shape[0]
    return None


def matrix_shape(store: Z.Store, key: str, sizes: tuple[int | None, int | None] = (None, None)) -> tuple[int, int] | None:
    """Rows and columns as stored; sizes of the axes settle what a file leaves open."""
    known = store.attrs(key)
    if store.kind(key) == "array":
        shape = tuple(store.array(key).shape)
        return (shape[1], shape[0]) if known.get("transposed") else shape
    if store.kind(key) != "group":
        return None
    for name in ("shape", "h5sparse_shape", "dims"):
        if name in known:
            return tuple(int(x) for x in known[name])
    if store.kind(Z.join(key, "shape")) == "array":
        return tuple(store.array(Z.join(key, "shape")).read().tolist())
    return sizes if None not in sizes else None


def layout(store: Z.Store, key: str, sizes: tuple[int | None, int | None]) -> dict:
    """How a sparse group is laid out: kind (csr, csc or coo), and the names of its parts. Files that don't say are
    settled by the length of the pointers, then by rows."""
    known = store.attrs(key)
    names = ("data", "indices", "indptr")
    if store.kind(Z.join(key, "indptr")) is None and all(store.kind(Z.join(key, x)) == "array" for x in "xip"):
        names = ("x", "i", "p")
    kind = known.get("encoding-type") or known.get("h5sparse_format") or known.get("format")
    if kind is not None:
        return {"kind": kind.removesuffix("_matrix"), "names": names}
    length = store.array(Z.join(key, names[2])).shape[0] - 1
    n, p = sizes
    return {"kind": "csc" if length == p and length != n else "csr", "names": names}


def shape_of(store: Z.Store) -> tuple[int, int]:
    sizes = (axis_length(store, "obs"), axis_length(store, "var"))
    if None not in sizes:
        return sizes
    if (shape := matrix_shape(store, "X")) is not None:
        return shape
    raise DataError("the store has no X of known shape")


def _legacy(store: Z.Store, key: str) -> str | None:
    """Where old files keep the categories of a column of codes."""
    top, _, name = key.rpartition("/")
    found = Z.join(top, "__categories", name)
    return found if store.kind(found) == "array" else None


def column_type(store: Z.Store, key: str) -> str:
    if store.kind(key) == "group":
        a = store.attrs(key)
        if a.get("encoding-type") == "categorical":
            return "string"
        return column_type(store, Z.join(key, "values"))
    array = store.array(key)
    return "string" if array.strings or _legacy(store, key) else {"b": "boolean", "f": "double"}.get(array.dtype.kind, "long")


def read_column(store: Z.Store, key: str, begin: int, end: int) -> list:
    """Values of a column: plain, categorical (-1 and codes out of range: null) or with a mask."""
    names = codes = None
    if store.kind(key) == "group":
        if store.attrs(key).get("encoding-type") != "categorical":
            mask = store.array(Z.join(key, "mask")).read(begin, end)
            return [None if m else v for m, v in zip(mask, store.array(Z.join(key, "values")).read(begin, end).tolist(), strict=True)]
        names, codes = Z.join(key, "categories"), Z.join(key, "codes")
    elif legacy := _legacy(store, key):
        names, codes = legacy, key
    if names is None:
        return store.array(key).read(begin, end).tolist()
    labels = [str(x) for x in store.array(names).read()]
    return [labels[c] if 0 <= c < len(labels) else None for c in store.array(codes).read(begin, end).tolist()]


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.store, self.part = _open(options), options.get("component", "X")
        self.schema_, self.low, self.high, self.some = schema, 0, None, None
        self.rows = int(options.get("rows", ROWS))
        self.sizes = shape_of(self.store) if self.part.split("/")[0] != "raw" else (axis_length(self.store, "obs"), axis_length(self.store, "raw/var"))
        top, key = self.part.split("/")[0], self.part
        self.square = top in ("obsp", "varp")
        #: A matrix whose stored rows are the second axis, and why.
        self.swap = self.layout = None
        if top in ("X", "layers", "obsp", "varp", "raw") and not key.endswith("/var"):
            sizes = (self.sizes[top == "varp"],) * 2 if self.square else self.sizes
            if self.store.kind(key) == "group":
                self.layout = layout(self.store, key, sizes)
                self.swap = self.layout["kind"] == "csc"
            else:
                stored = tuple(self.store.array(key).shape)
                # stored the other way round if only that fits
                self.swap = bool(self.store.attrs(key).get("transposed")) or (stored != sizes and stored == sizes[::-1])

    @property
    def axis(self) -> str:
        return self.schema_.names[0]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.axis,):
                if isinstance(f, EqualTo):
                    self.some = {f.value} if self.some is None else self.some & {f.value}
                elif isinstance(f, In):
                    self.some = {*f.value} if self.some is None else self.some & {*f.value}
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # ranges are coarse: Spark filters their rows again

    def _length(self) -> int:
        top = self.part.split("/")[0]
        if self.layout and self.layout["kind"] == "coo":
            return self.store.array(Z.join(self.part, "data")).shape[0]
        if top in ("var", "varm", "varp") or self.part == "raw/var":
            return self.sizes[1]
        return self.sizes[1] if self.swap and not self.square else self.sizes[0]

    def partitions(self) -> list[Range]:
        n = self._length()
        out = [Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        if self.swap or self.layout and self.layout["kind"] == "coo":
            return out or [Range(0, 0)]  # filters are on the other axis
        out = [r for r in out if r.end > self.low and (self.high is None or r.begin < self.high)]
        out = [r for r in out if self.some is None or any(r.begin <= v < r.end for v in self.some)]
        return out or [Range(0, 0)]  # Spark reads at least one partition

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, key, a, b = self.store, self.part, part.begin, part.end
        top = key.split("/")[0]
        if top in ("obs", "var") or key == "raw/var":
            index = index_of(store, key)
            names = index.read(a, b).tolist() if index else [f"{'Cell' if top == 'obs' else 'Gene'}{k + 1}" for k in range(a, b)]
            columns = [pa.array(range(a, b), pa.int64()), pa.array([str(x) for x in names], pa.string())]
            for field in self.schema_.fields[2:]:
                kind = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[field.dataType.simpleString()]
                columns.append(pa.array(read_column(store, Z.join(key, field.name), a, b), kind))
            yield pa.RecordBatch.from_arrays(columns, names=self.schema_.names)
        elif top in ("obsm", "varm"):
            if store.kind(key) == "group":  # a table of numbers: its columns side by side
                values = np.stack([np.array([np.nan if v is None else v for v in read_column(store, Z.join(key, c), a, b)], float) for c in frame_columns(store, key)], axis=1)
            else:
                values = store.array(key).read(a, b).astype(float)
            values = values.reshape(len(values), -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), flat], names=self.schema_.names)
        else:
            yield from self._matrix(key, a, b)

    def _matrix(self, key: str, a: int, b: int) -> Iterator[pa.RecordBatch]:
        store = self.store
        if self.layout is None:
            yield from self._dense(store.array(key), a, b)
            return
        if self.layout["kind"] == "coo":
            major, minor, value = (store.array(Z.join(key, x)).read(a, b) for x in ("row", "col", "data"))
        else:
            names = self.layout["names"]
            ptr = store.array(Z.join(key, names[2])).read(a, b + 1).astype(np.int64)
            data, indices = store.array(Z.join(key, names[0])), store.array(Z.join(key, names[1]))
            if len(ptr) != b - a + 1 or ptr[-1] > data.shape[0] or data.shape != indices.shape:
                raise DataError(f"{key}: data, indices and indptr don't fit")
            if b == self._length() and ptr[-1] != data.shape[0]:
                raise DataError(f"{key}: indptr ends at {ptr[-1]}, there are {data.shape[0]} values")
            value, minor = data.read(int(ptr[0]), int(ptr[-1])), indices.read(int(ptr[0]), int(ptr[-1]))
            major = np.repeat(np.arange(a, b), np.diff(ptr))
        yield from self._rows(major, minor, value)

    def _dense(self, array, a: int, b: int) -> Iterator[pa.RecordBatch]:
        """A block at a time, so that a wide matrix is never held by whole rows of a partition."""
        held, size = [], 0
        for part in getattr(array, "entries", lambda a, b: slices(array, a, b))(a, b):
            held.append(part)
            size += len(part[2])
            if size >= CHUNK:
                yield from self._rows(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
        if size:
            yield from self._rows(*[np.concatenate(x) for x in zip(*held, strict=True)])

    def _rows(self, major: np.ndarray, minor: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, cols = (minor, major) if self.swap else (major, minor)
        for at in range(0, len(value), CHUNK):
            s = slice(at, at + CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(rows[s].astype(np.int64)), pa.array(cols[s].astype(np.int64)), pa.array(value[s].astype(float))], names=self.schema_.names)


class AnnDataZarr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "anndata_zarr"

    def schema(self) -> str:
        store, part = _open(self.options), self.options.get("component", "X")
        top = part.split("/")[0]
        if store.kind(part) is None:
            raise DataError(f"the store has no {part}")
        if top in ("obs", "var") or part == "raw/var":
            axis = "var" if top == "raw" else top
            return ", ".join([f"{axis}_idx long, {axis}_id string", *[f"`{c}` {column_type(store, Z.join(part, c))}" for c in frame_columns(store, part)]])
        if top in ("obsm", "varm"):
            return f"{top[:3]}_idx long, vec array<double>"
        return "i long, j long, w double" if top in ("obsp", "varp") else "obs_idx long, var_idx long, value double"

    def reader(self, schema) -> DataSourceReader:
        return ZarrReader(self.options, schema)


def component(spark: SparkSession, path: str, part: str, **options) -> DataFrame:
    """One part of a file or store, lazily. Filters on the row index drop ranges of rows where the session allows
    filter push-down to Python sources, which this turns on."""
    spark.dataSource.register(AnnDataZarr)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("anndata_zarr").option("path", path).option("component", part).options(**{k: v for k, v in options.items() if v is not None}).load()


def _fitting(store: Z.Store, top: str, size: int, square: bool) -> list[str]:
    """The keys of a group whose entries fit the axis; others are left out with a warning."""
    out = []
    for k in store.children(top):
        key = Z.join(top, k)
        if square:
            shape = matrix_shape(store, key, (size, size))
            fits = shape == (size, size)
        else:
            shape = axis_length(store, key) if store.kind(key) == "group" else store.array(key).shape[0]
            fits = shape == size
        if fits:
            out.append(k)
        else:
            warnings.warn(f"{key} is left out: its shape is {shape}, its axis has {size} entries", ShapeWarning, stacklevel=4)
    return out


def read_tree(spark: SparkSession, path: str, components: Iterable[str] | None = None, include_x: bool = True, layers: list[str] | None = None, obsm: list[str] | None = None, obsp: list[str] | None = None, check: bool = True, **options) -> Container:
    """A lazy container of a store, a file or a view of one; parts that aren't asked for are not even listed.

    layers, obsm, obsp: names to read (None: all). include_x=False gives an empty X of the right shape. Where X is missing
    raw/X stands in for it. Counts come from the place that verify.counts_place() finds; those of raw/X become the layer
    ``counts``, for features that obs and raw share. check: repeated names are made unique (the stored ones are kept in
    orig_obs_index or orig_var_index) and counts that aren't whole numbers are noted, both with a warning."""
    store = _open({"path": path, **options})
    for part in ("obs", "var"):
        if store.kind(part) is None:
            raise DataError(f"{path} has no {part}")
    main = "X" if store.kind("X") is not None else "raw/X" if store.kind("raw/X") is not None else None
    if main is None and include_x:
        raise DataError(f"{path} has no X")
    n, p = shape_of(store)
    if main == "X" and (shape := matrix_shape(store, "X", (n, p))) not in ((n, p), (p, n)):
        raise DataError(f"{path}: X is {shape}, obs and var have {(n, p)}")
    want = None if components is None else {*components}
    asked = lambda part: want is None or part in want
    read = lambda part: component(spark, path, part, **options)

    def keyed(top: str, keys: list[str], name: str = "key") -> DataFrame | None:
        return _union([read(f"{top}/{k}").select(F.lit(k).alias(name), "*") for k in keys])

    def chosen(top: str, names: list[str] | None, size: int, square: bool) -> list[str]:
        if not asked(top):
            return []
        there = _fitting(store, top, size, square)
        if names is None:
            return there
        if missing := [k for k in names if k not in there]:
            warnings.warn(f"{path} has no {top} {missing}; there are {there}", ShapeWarning, stacklevel=3)
        return [k for k in names if k in there]

    parts = [read(main).select(F.lit("X").alias("layer"), "*")] if include_x and main == "X" else []
    stored = [k for k in store.children("layers") if asked("layers") and (layers is None or k in layers)]
    for k in stored:
        if (shape := matrix_shape(store, f"layers/{k}", (n, p))) not in ((n, p), (p, n)):
            raise DataError(f"{path}: layer {k} is {shape}, obs and var have {(n, p)}")
    if stored:
        parts.append(keyed("layers", stored, "layer"))
    place = counts_place(stamp_of(store), "counts" in store.children("layers"), store.kind("raw/X") is not None)
    if store.kind("raw/X") is not None and (place == "raw/X" or main == "raw/X") and include_x:
        raw = raw_counts(read("raw/X"), read("raw/var") if store.kind("raw/var") is not None else None, read("var"))
        if main == "raw/X":
            parts.append(raw.select(F.lit("X").alias("layer"), "*"))
        elif "counts" not in stored:
            parts.append(raw.select(F.lit("counts").alias("layer"), "*"))
    tables = {
        "obsm": keyed("obsm", chosen("obsm", obsm, n, False)), "varm": keyed("varm", chosen("varm", None, p, False)),
        "obsp": keyed("obsp", chosen("obsp", obsp, n, True)), "varp": keyed("varp", chosen("varp", None, p, True)),
        "uns": uns_frame(spark, store, skip=HELD) if asked("uns") else None,
    }
    drawn = read_spatial(spark, store) if asked("uns") or asked("spatial") else {}
    levels = [] if not hasattr(store, "levels") else store.levels()
    for top in ("obs", "var"):
        for c in frame_columns(store, top):
            key = Z.join(top, c)
            if store.kind(key) == "group" and store.attrs(key).get("encoding-type") == "categorical":
                ordered = bool(store.attrs(key).get("ordered", False))
                levels += [(top, c, k, str(v), ordered) for k, v in enumerate(store.array(Z.join(key, "categories")).read().tolist())]
    obs, var = read("obs"), read("var")
    if check:
        obs, var = at_once(spark, lambda: unique_names(obs, "obs"), lambda: unique_names(var, "var"))
        if include_x:
            warn_fractional(store, place if store.kind(place) is not None else main)
    facts = dict(store.attrs("")) | {"counts_from": place, "x_holds": "counts" if place == "X" else "data"}
    c = Container.of(spark, (n, p), facts, obs=obs, var=var, matrix=_union(parts), levels=spark.createDataFrame(levels, "tbl string, col string, code long, label string, ordered boolean"), **tables)
    c.tables |= drawn
    return c


def read_zarr(spark: SparkSession, path: str, components: Iterable[str] | None = None, **options) -> Container:
    return read_tree(spark, path, components, **options)


def read_obs(spark: SparkSession, path: str, **options) -> DataFrame:
    """The cell table alone: nothing else of the file is opened."""
    return component(spark, path, "obs", **options)


def read_embeddings(spark: SparkSession, path: str, keys: list[str] | None = None, **options) -> DataFrame:
    """key, obs_idx, vec of the embeddings alone."""
    store = _open({"path": path, **options})
    names = [k for k in store.children("obsm") if keys is None or k in keys]
    found = _union([component(spark, path, f"obsm/{k}", **options).select(F.lit(k).alias("key"), "*") for k in names])
    return found if found is not None else spark.createDataFrame([], SCHEMAS["obsm"])


def stamp_of(store: Z.Store) -> str | None:
    """Where a writer says that it put the counts: uns/<any>/counts_location."""
    for k in store.children("uns"):
        if store.kind(f"uns/{k}/counts_location") == "array":
            return str(np.asarray(store.array(f"uns/{k}/counts_location").read()).reshape(-1)[0])
    return None


def raw_counts(raw: DataFrame, raw_var: DataFrame | None, var: DataFrame) -> DataFrame:
    """The raw matrix on the positions of var: features in common, by name (underscores count as dashes); the first of
    repeated names stands for all. Without names raw must have var's positions."""
    if raw_var is None:
        return raw.select("obs_idx", "var_idx", "value")
    name = F.replace("var_id", F.lit("_"), F.lit("-"))
    new = var.groupBy(name.alias("__n")).agg(F.min("var_idx").alias("__new"))
    old = raw_var.groupBy(name.alias("__n")).agg(F.min("var_idx").alias("var_idx"))
    return raw.join(old.join(new, "__n"), "var_idx").select("obs_idx", F.col("__new").alias("var_idx"), "value")


def unique_names(frame: DataFrame, axis: str) -> DataFrame:
    """frame with unique names; where some were repeated, orig_<axis>_index holds those that were stored."""
    ident = f"{axis}_id"
    if frame.groupBy(ident).count().filter("count > 1").isEmpty():
        return frame
    warnings.warn(f"names in {axis} are repeated; later ones get a suffix", NamesWarning, stacklevel=3)
    named = make_unique(frame, ident, f"{axis}_idx", "__unique")
    rest = [F.col(f"`{c}`") for c in frame.columns if c not in (f"{axis}_idx", ident)]
    return named.select(f"{axis}_idx", F.col("__unique").alias(ident), *rest, F.col(ident).alias(f"orig_{axis}_index"))


def warn_fractional(store: Z.Store, key: str, head: int = 100_000) -> None:
    """Warns if the first stored values of the counts aren't whole numbers."""
    if store.kind(key) == "group":
        names = layout(store, key, (None, 0))["names"] if store.attrs(key).get("encoding-type") is None else ("data",)
        values = store.array(Z.join(key, names[0])).read(0, head)
    else:
        array = store.array(key)
        values = array.read(0, max(1, head // max(1, array.shape[-1])))
    values = np.asarray(values, float)
    if values.size and not np.equal(np.mod(values, 1), 0).all():
        warnings.warn(f"{key} should hold counts, but has values that aren't whole numbers", CountsWarning, stacklevel=3)


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    parts = [p for p in parts if p is not None]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


TEXT = {"encoding-type": "string-array", "encoding-version": "0.2.0"}
_CSR = {"encoding-type": "csr_matrix", "encoding-version": "0.1.0"}


class Columns:
    """The arrays that a frame is stored as, and how they follow from a batch of its rows.

    plan: (key below the frame, column, part, dtype); part is value, mask or codes."""

    def __init__(self, df: DataFrame, top: str, levels: DataFrame):
        self.index, ident = df.columns[:2]
        kinds = dict(df.dtypes)
        self.names = df.columns[2:]
        self.labels: dict[str, list[str]] = {}
        self.ordered: dict[str, bool] = {}
        for r in levels.filter(F.col("tbl") == top).orderBy("col", "code").toLocalIterator():
            self.labels.setdefault(r.col, []).append(r.label)
            self.ordered[r.col] = bool(r.ordered)
        null = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(self.names)]).first() if self.names else []
        self.groups: dict[str, dict] = {}
        self.plan = [("_index", ident, "value", "string")]
        for c, some in zip(self.names, null, strict=True):
            kind = kinds[c]
            if c in self.labels and kind == "string":
                self.groups[c] = {"encoding-type": "categorical", "encoding-version": "0.2.0", "ordered": self.ordered[c]}
                self.plan.append((f"{c}/codes", c, "codes", code_type(len(self.labels[c]), bool(some))))
                continue
            if kind not in _STORED:
                raise DataError(f"column {c} of {top} is {kind}, which can't be stored; there are {sorted(_STORED)}")
            dtype, encoding = _STORED[kind]
            if some:
                self.groups[c] = {"encoding-type": encoding, "encoding-version": "0.1.0"}
                self.plan += [(f"{c}/values", c, "value", dtype), (f"{c}/mask", c, "mask", "bool")]
            else:
                self.plan.append((c, c, "value", dtype))

    @property
    def attrs(self) -> dict:
        return {"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": "_index", "column-order": self.names}

    def values(self, part: pa.Array | pa.ChunkedArray, column: str, how: str, dtype: str):
        """A list of strings or an array."""
        if how == "mask":
            return np.asarray(part.is_null())
        if how == "codes":
            at = pc.index_in(part, value_set=pa.array(self.labels[column], pa.string()))
            return np.asarray(pc.fill_null(at, -1)).astype(dtype)
        if dtype == "string":
            return [v if v is not None else "" for v in part.to_pylist()]
        return np.asarray(pc.fill_null(part.cast(pa.bool_() if dtype == "bool" else pa.float64() if dtype == "<f8" else pa.int64()), 0 if dtype != "bool" else False))


#: Spark type -> stored type and the encoding of a column with nulls.
_STORED = {"string": ("string", "nullable-string-array"), "boolean": ("bool", "nullable-boolean")} | {k: ("<f8", "nullable-integer") for k in ("double", "float")} | {k: ("<i8", "nullable-integer") for k in ("bigint", "int", "smallint", "tinyint")}


def code_type(n: int, nulls: bool) -> str:
    """The narrowest type that holds the codes of n categories (and -1, where there are nulls)."""
    for most, signed, dtype in ((127, True, "|i1"), (255, False, "|u1"), (32767, True, "<i2"), (65535, False, "<u2")):
        if n <= most and (signed or not nulls):
            return dtype
    return "<i4"


def all_matrices(c: Container, at: str = "") -> DataFrame:
    """(name, i, j, v) of layers and graphs, name being the key in the tree."""
    layer = F.when(F.col("layer") == "X", f"{at}X").otherwise(F.concat(F.lit(f"{at}layers/"), "layer"))
    out = c.matrix.select(layer.alias("name"), F.col("obs_idx").alias("i"), F.col("var_idx").alias("j"), F.col("value").cast("double").alias("v"))
    for top in ("obsp", "varp"):
        out = out.unionByName(c.tables[top].select(F.concat(F.lit(f"{at}{top}/"), "key").alias("name"), "i", "j", F.col("w").cast("double").alias("v")))
    return out


def matrix_shape_of(name: str, shape: tuple[int, int], at: str = "") -> tuple[int, int]:
    """The shape of what all_matrices() calls so."""
    top = name[len(at) :].partition("/")[0]
    return (shape[0],) * 2 if top == "obsp" else (shape[1],) * 2 if top == "varp" else shape


def all_vectors(c: Container, at: str = "") -> DataFrame:
    """(name, i, vec) of embeddings and loadings."""
    out = None
    for top in ("obsm", "varm"):
        own = c.tables[top].select(F.concat(F.lit(f"{at}{top}/"), "key").alias("name"), F.col(f"{top[:3]}_idx").alias("i"), F.col("vec").cast("array<double>").alias("vec"))
        out = own if out is None else out.unionByName(own)
    return out


def vector_shapes(c: Container, at: str = "") -> dict[str, tuple[int, int]]:
    """Rows and columns of what all_vectors() names."""
    sizes = all_vectors(c, at).groupBy("name").agg(F.max(F.size("vec")).alias("k")).collect()  # a row a key
    return {r.name: (c.shape[r.name[len(at) :].startswith("varm")], max(1, r.k)) for r in sizes}


def at_once(spark: SparkSession, *calls) -> list:
    """What the calls return; their jobs run side by side."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


class ZarrSink:
    """Writes arrays of a store; each task writes whole chunks, all arrays of a chunk at once."""

    def __init__(self, store: Z.Store, codec: str, level: int, version: int):
        self.store, self.how = store, (codec, level, version)

    def group(self, key: str, attributes: dict) -> None:
        Z.write_group(self.store, key, attributes, self.how[2])

    def put(self, key: str, value: np.ndarray, attributes: dict) -> None:
        """A small array, from the driver."""
        dtype = "string" if value.dtype == object else value.dtype.str
        chunks = [max(1, s) for s in value.shape]
        Z.write_meta(self.store, key, list(value.shape), chunks, dtype, *self.how, attributes)
        if value.size:
            Z.write_chunk(self.store, key, (0,) * value.ndim, value.reshape(-1).tolist() if dtype == "string" else value, chunks, dtype, *self.how)

    def _chunks(self, df: DataFrame, pos: str, keys: list[str], write, what: dict) -> None:
        """write(table in the order of pos, chunk, *keys) for each chunk; what: rows expected of each key."""

        def put(table: pa.Table) -> pa.Table:
            table = table.sort_by(pos)
            write(table, int(table["__chunk"][0].as_py()), *[table[k][0].as_py() for k in keys])
            return pa.table({"name": pa.array(["/".join(str(table[k][0]) for k in keys)]), "n": pa.array([table.num_rows], pa.int64())})

        found = df.groupBy(*keys, "__chunk").applyInArrow(put, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
        got = {r.name: r.n for r in found}
        for key, n in what.items():
            if got.get(key, 0) != n:
                raise DataError(f"{key or pos}: {got.get(key, 0)} rows for {n} places")

    def frame(self, df: DataFrame, top: str, n: int, levels: DataFrame) -> None:
        columns, size, store, how = Columns(df, top, levels), max(1, min(CHUNK, n)), self.store, self.how
        self.group(top, columns.attrs)
        for c, attributes in columns.groups.items():
            self.group(f"{top}/{c}", attributes)
        for c in columns.groups:
            if c in columns.labels:
                self.put(f"{top}/{c}/categories", np.array([*columns.labels[c], None], dtype=object)[:-1], TEXT)
        for key, _, _, dtype in columns.plan:
            Z.write_meta(store, f"{top}/{key}", [n], [size], dtype, *how, TEXT if dtype == "string" else None)

        def write(table: pa.Table, chunk: int) -> None:
            for key, c, part, dtype in columns.plan:
                Z.write_chunk(store, f"{top}/{key}", (chunk,), columns.values(table[c].combine_chunks(), c, part, dtype), [size], dtype, *how)

        self._chunks(df.withColumn("__chunk", F.floor(F.col(columns.index) / size)), columns.index, [], write, {"": n} if n else {})

    def matrices(self, coo: DataFrame, shape: tuple[int, int], always: tuple[str, ...] = ("X",)) -> None:
        """coo: name, i, j, v. The entries of BUCKET rows in a row are placed after those of the buckets before. always:
        matrices that are written even if nothing stands in them."""
        store, how = self.store, self.how
        coo = coo.withColumn("b", F.floor(F.col("i") / BUCKET)).persist(StorageLevel.DISK_ONLY)
        counts = coo.groupBy("name", "b", "i").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
        try:
            sums = counts.groupBy("name", "b").agg(F.sum("n").alias("n"))
            before = F.sum("n").over(Window.partitionBy("name").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
            starts = sums.select("name", "b", F.coalesce(before, F.lit(0)).alias("start"))
            nnz = dict.fromkeys(always, 0) | {r.name: r.n for r in sums.groupBy("name").agg(F.sum("n").alias("n")).collect()}
            shapes = {name: matrix_shape_of(name, shape) for name in nnz}
            for name, (rows, cols) in shapes.items():
                self.group(name, _CSR | {"shape": [rows, cols]})
                for part, n, dtype in (("indptr", rows + 1, "<i8"), ("indices", nnz[name], "<i8"), ("data", nnz[name], "<f8")):
                    Z.write_meta(store, f"{name}/{part}", [n], [CHUNK], dtype, *how)

            def put_entries(table: pa.Table, chunk: int, name: str) -> None:
                Z.write_chunk(store, f"{name}/indices", (chunk,), np.asarray(table["j"]), [CHUNK], "<i8", *how)
                Z.write_chunk(store, f"{name}/data", (chunk,), np.asarray(table["v"]), [CHUNK], "<f8", *how)

            def put_pointers(table: pa.Table, chunk: int, name: str) -> None:
                Z.write_chunk(store, f"{name}/indptr", (chunk,), np.asarray(table["ptr"]), [CHUNK], "<i8", *how)

            def entries() -> None:
                rank = F.row_number().over(Window.partitionBy("name", "b").orderBy("i", "j")) - 1
                placed = coo.withColumn("__rank", rank).join(starts, ["name", "b"]).select("name", "j", "v", (F.col("start") + F.col("__rank")).alias("pos"))
                self._chunks(placed.withColumn("__chunk", F.floor(F.col("pos") / CHUNK)), "pos", ["name"], put_entries, nnz)

            def pointers() -> None:
                spark = coo.sparkSession
                axis = spark.createDataFrame([(k, r + 1) for k, (r, _) in shapes.items()], "name string, rows long")
                axis = axis.select("name", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BUCKET))).alias("b"), "rows")  # then BUCKET places of each
                axis = axis.select("name", "b", F.explode(F.sequence(F.col("b") * BUCKET, F.least(F.col("rows"), (F.col("b") + 1) * BUCKET) - 1)).alias("pos"))
                # place k + 1 holds the end of row k
                ends = axis.join(counts.select("name", (F.col("i") + 1).alias("pos"), "n"), ["name", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                ends = running_sum(ends.drop("b"), "n", "pos", ("name",), "ptr")
                self._chunks(ends.withColumn("__chunk", F.floor(F.col("pos") / CHUNK)), "pos", ["name"], put_pointers, {k: r + 1 for k, (r, _) in shapes.items()})

            at_once(coo.sparkSession, entries, pointers)
        finally:
            counts.unpersist()
            coo.unpersist()

    def vectors(self, rows: DataFrame, shapes: dict[str, tuple[int, int]]) -> None:
        """rows: name, i, vec. Rows that are missing are NaN."""
        if not shapes:
            return
        store, how = self.store, self.how
        sizes = {k: max(1, min(n, CHUNK // d)) for k, (n, d) in shapes.items()}
        for k, (n, d) in shapes.items():
            Z.write_meta(store, k, [n, d], [sizes[k], d], "<f8", *how, {"encoding-type": "array", "encoding-version": "0.2.0"}, fill="NaN")

        def write(table: pa.Table, chunk: int, name: str) -> None:
            values = np.full((sizes[name], shapes[name][1]), np.nan)
            for at, vec in zip(np.asarray(table["i"]) - chunk * sizes[name], table["vec"].to_pylist(), strict=True):
                values[at, : len(vec)] = vec
            Z.write_chunk(store, name, (chunk, 0), values, list(values.shape), "<f8", *how)

        size = F.lit(1)
        for k, v in sizes.items():
            size = F.when(F.col("name") == k, v).otherwise(size)
        self._chunks(rows.withColumn("__chunk", F.floor(F.col("i") / size)), "i", ["name"], write, {})


def write_zarr(c: Container, path: str, overwrite: bool = False, codec: str = "zlib", level: int = 1, version: int = 2) -> None:
    """X, layers, obs, var, obsm, varm, obsp, varp and uns; atomic: the store appears when all of it is written. Level 0
    stores chunks as they are."""
    tmp, commit = replace_dir(c.spark, path, overwrite)
    sink = ZarrSink(Z.Store(tmp), codec if level else "none", level, version)
    sink.group("", {"encoding-type": "anndata", "encoding-version": "0.1.0"})
    for top in ("layers", "obsm", "varm", "obsp", "varp"):
        sink.group(top, {"encoding-type": "dict", "encoding-version": "0.1.0"})
    at_once(
        c.spark, lambda: sink.matrices(all_matrices(c), c.shape), lambda: sink.frame(c.obs, "obs", c.shape[0], c.levels), lambda: sink.frame(c.var, "var", c.shape[1], c.levels),
        lambda: sink.vectors(all_vectors(c), vector_shapes(c)),
    )
    write_uns(((r.path, r.value) for r in c.uns.orderBy("path").toLocalIterator()), sink.group, sink.put)
    write_spatial(c.tables, sink.group, sink.put, lambda *what: ZarrGrowing(sink.store, sink.how, *what), batches)
    commit()


def batches(df: DataFrame, *order: str) -> Iterator[pa.RecordBatch]:
    """The rows in a total order, as Arrow batches, a partition at a time."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

    for row in df.orderBy(*order).mapInArrow(pack, "b binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(row.b).read_next_batch()


def ahead(spark: SparkSession, parts: Iterator, room: int = 4) -> Iterator:
    """What parts gives, produced by a thread that begins at once and is at most ``room`` parts ahead."""
    queue: Queue = Queue(room)
    stopped = Event()

    def offer(item) -> bool:
        while not stopped.is_set():
            try:
                queue.put(item, timeout=1)
                return True
            except Full:
                continue
        return False

    def run() -> None:
        try:
            for part in parts:
                if not offer((part, None)):
                    return
            offer((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001  handed to the reader
            offer((None, e))

    Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()

    def read() -> Iterator:
        try:
            while True:
                part, end = queue.get()
                if isinstance(end, StopIteration):
                    return
                if end is not None:
                    raise end
                yield part
        finally:
            stopped.set()

    return read()


def _axes(store: Z.Store, key: str) -> tuple[list[str] | None, str]:
    """Names of an image's axes, and where its largest resolution is."""
    known = store.attrs(key)
    known = known.get("ome", known).get("multiscales") or [{}]
    names = [a["name"] if isinstance(a, dict) else a for a in known[0].get("axes", [])] or None
    return names, Z.join(key, (known[0].get("datasets") or [{"path": "0"}])[0]["path"])


def read_spatialdata(spark: SparkSession, path: str, table: str = "table", images: bool = True, **options) -> Container:
    """The table of a SpatialData store, with its shapes and points as further tables (Parquet inside the store), and
    images and labels as tables of pixels (h, w, c, value) of their largest resolution."""
    store = Z.Store(path)
    if store.kind(f"tables/{table}") is None:
        raise DataError(f"{path} has no table {table}; there are {store.children('tables')}")
    c = read_zarr(spark, path, prefix=f"tables/{table}", **options)
    for top, file in (("shapes", "shapes.parquet"), ("points", "points.parquet")):
        for name in store.children(top):
            c.tables[f"{top}/{name}"] = spark.read.parquet(f"{path}/{top}/{name}/{file}")
    for top in ("images", "labels") if images else ():
        for name in store.children(top):
            names, at = _axes(store, f"{top}/{name}")
            c.tables[f"{top}/{name}"] = pixels(spark, store, at, names)
    c.attrs["labels"], c.attrs["images"] = store.children("labels"), store.children("images")
    return c


#: Rows and columns of a stored tile.
TILE = 256


def write_image(df: DataFrame, store: Z.Store, key: str, level: int = 1) -> None:
    """df: h, w, c, value. Channels first, in tiles that tasks write whole; what has no pixel is 0."""
    size = df.agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("c").alias("c")).first()
    h, w, c = (0 if size.h is None else x + 1 for x in (size.h, size.w, size.c))
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space"}, {"name": "x", "type": "space"}]
    Z.write_group(store, key, {"multiscales": [{"version": "0.4", "name": key.rpartition("/")[2], "axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "identity"}]}]}]})
    chunks, how = [max(1, c), max(1, min(h, TILE)), max(1, min(w, TILE))], ("zlib" if level else "none", level, 2)
    Z.write_meta(store, f"{key}/0", [c, h, w], chunks, "<f8", *how)

    def put(table: pa.Table) -> pa.Table:
        at = [np.asarray(table[k]) for k in ("c", "h", "w")]
        tile = np.zeros(chunks)
        y, x = int(at[1][0]) // chunks[1], int(at[2][0]) // chunks[2]
        tile[at[0], at[1] - y * chunks[1], at[2] - x * chunks[2]] = np.asarray(table["value"])
        Z.write_chunk(store, f"{key}/0", (0, y, x), tile, chunks, "<f8", *how)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    tiles = df.withColumns({"__y": F.floor(F.col("h") / chunks[1]), "__x": F.floor(F.col("w") / chunks[2])})
    tiles.groupBy("__y", "__x").applyInArrow(put, "n long").agg(F.sum("n")).collect()


def write_spatialdata(c: Container, path: str, overwrite: bool = False, table: str = "table", level: int = 1, version: int = 2, codec: str = "zlib") -> None:
    """The container as the store's table, and its extra tables shapes/<name>, points/<name>, images/<name> and
    labels/<name>."""
    tmp, commit = replace_dir(c.spark, path, overwrite)
    store = Z.Store(tmp)
    for key, attributes in (("", {"spatialdata_attrs": {"version": "0.1"}}), ("tables", {}), ("shapes", {}), ("points", {}), ("images", {}), ("labels", {})):
        Z.write_group(store, key, attributes)
    write_zarr(c, f"{tmp}/tables/{table}", level=level, version=version, codec=codec)
    for name, df in c.tables.items():
        top, _, own = name.partition("/")
        if own and top in ("shapes", "points"):
            Z.write_group(store, name, {"encoding-type": f"ngff:{top}"})
            df.write.parquet(f"{tmp}/{name}/{top}.parquet")
        elif own and top in ("images", "labels"):
            write_image(df, store, name, level)
    commit()
