"""h5ad, h5mu, h5Seurat, Loom and GEF files on the pure-Python HDF5 layer.

Reading is the same data source as for Zarr, over views that show each layout as one tree: executors open the file and
read their rows. A file has one writer: sorted Arrow batches stream through the driver, each table in one pass, and its
datasets grow side by side; nothing is held but a batch and a chunk of each dataset. The path must be one that driver and
executors share.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import DataError
from . import views
from .container import Container
from .hdf5 import SMALL, Segment, Tiles, Tree, Writer
from .spatial import write_spatial
from .uns import write_uns
from .zarr import _CSR, TEXT, Columns, ahead, all_matrices, all_vectors, at_once, batches, matrix_shape_of, read_tree, vector_shapes

#: Rows of an axis that are written at once where nothing stands in them.
PART = 65536
#: Rows of metadata, and characters of their values, that a task makes one piece of a file of.
PIECE, LENGTH = 20_000, 1 << 23


def read_h5ad(spark: SparkSession, path: str, components: Iterable[str] | None = None, **options) -> Container:
    return read_tree(spark, path, components, **options)


def _target(path: str, overwrite: bool) -> str:
    path = path.removeprefix("file://")
    if "://" in path:
        raise DataError(f"{path}: HDF5 files are written to shared file systems, not to object stores; write Zarr or Parquet there")
    if os.path.exists(path) and not overwrite:
        raise DataError(f"{path} exists; set overwrite to replace it")
    return path


class _Csr:
    """indptr, indices and data of one matrix, from entries in order."""

    def __init__(self, w: Writer, key: str, shape: tuple[int, int], attributes: dict | None = None):
        w.group(key, (_CSR | {"shape": list(shape)}) | (attributes or {}))
        self.rows, self.at, self.count = shape[0], 0, 0
        self.ptr, self.indices, self.data = (w.grow(f"{key}/{k}", t) for k, t in (("indptr", "<i8"), ("indices", "<i8"), ("data", "<f8")))
        self.ptr.add(np.zeros(1, np.int64))

    def add(self, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
        self._close_rows(int(i[-1]), i)
        self.indices.add(j)
        self.data.add(v)
        self.count += len(i)

    def _close_rows(self, until: int, i: np.ndarray | None = None) -> None:
        """Ends of the rows before ``until``."""
        for a in range(self.at, until, PART):
            rows = np.arange(a, min(until, a + PART))
            self.ptr.add(self.count + (np.searchsorted(i, rows, "right") if i is not None else np.zeros(len(rows), np.int64)))
        self.at = max(self.at, until)

    def close(self) -> None:
        self._close_rows(self.rows)
        for d in (self.ptr, self.indices, self.data):
            d.close()


def _matrices(w: Writer, parts: Iterator[pa.RecordBatch], shape: tuple[int, int], at: str = "", place=lambda name: (name, {}), always: tuple[str, ...] = ("X",)) -> None:
    """parts: name, i, j, v in order. place(name) -> where it is written, and attributes."""
    name = current = None
    done = set()

    def begin(name: str) -> _Csr:
        key, attributes = place(name)
        return _Csr(w, key, matrix_shape_of(name, shape, at), attributes)

    for part in parts:
        names = part.column(0).dictionary_encode()
        codes, (i, j, v) = np.asarray(names.indices), (np.asarray(part.column(k)) for k in (1, 2, 3))
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (own := names.dictionary[int(codes[a])].as_py()) != name:
                if current:
                    current.close()
                name, current = own, begin(own)
                done.add(own)
            current.add(i[a:b], j[a:b], v[a:b])
    if current:
        current.close()
    for own in always:
        if f"{at}{own}" not in done:
            begin(f"{at}{own}").close()


def _vectors(w: Writer, parts: Iterator[pa.RecordBatch], shapes: dict[str, tuple[int, int]], places: dict[str, str] | None = None) -> None:
    """parts: name, i, vec in order; rows that are missing are NaN."""
    open_, at = {}, {}
    encoded = {"encoding-type": "array", "encoding-version": "0.2.0"}

    def blank(name: str, until: int) -> None:
        for a in range(at[name], until, PART):
            open_[name].add(np.full((min(until, a + PART) - a, shapes[name][1]), np.nan))
        at[name] = until

    for name, (_, k) in shapes.items():
        open_[name], at[name] = w.grow((places or {}).get(name, name), "<f8", (k,), encoded), 0
    for part in parts:
        names, i = part.column(0).dictionary_encode(), np.asarray(part.column(1))
        codes, sizes, flat = np.asarray(names.indices), np.asarray(pc.list_value_length(part.column(2))), np.asarray(pc.fill_null(part.column(2).flatten(), np.nan))
        begins = np.cumsum(sizes) - sizes
        cuts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(i, prepend=-2) != 1)).tolist()  # runs of rows
        for a, b in zip(cuts, [*cuts[1:], len(i)], strict=True):
            name = names.dictionary[int(codes[a])].as_py()
            blank(name, int(i[a]))
            lines = np.full((b - a, shapes[name][1]), np.nan)
            col = np.arange(int(sizes[a:b].sum())) - np.repeat(begins[a:b] - begins[a], sizes[a:b])
            lines[np.repeat(np.arange(b - a), sizes[a:b]), col] = flat[begins[a] : begins[a] + len(col)]
            open_[name].add(lines)
            at[name] = int(i[a]) + b - a
    for name, (n, _) in shapes.items():
        blank(name, n)
        open_[name].close()


def _frame(w: Writer, top: str, columns: Columns, parts: Iterator[pa.RecordBatch], n: int, at: str = "") -> None:
    w.group(f"{at}{top}", columns.attrs)
    for c, attributes in columns.groups.items():
        w.group(f"{at}{top}/{c}", attributes)
        if c in columns.labels:
            w.dataset(f"{at}{top}/{c}/categories", [columns.labels[c]], [len(columns.labels[c])], "string", TEXT)
    open_ = [(w.grow(f"{at}{top}/{key}", dtype, (), TEXT if dtype == "string" else None), c, part, dtype) for key, c, part, dtype in columns.plan]
    _stream(parts, columns, open_, n, top)


def _whole_frame(w: Writer, top: str, df: DataFrame, n: int, levels: DataFrame, at: str = "") -> None:
    _frame(w, top, Columns(df, top, levels), batches(df, df.columns[0]), n, at)


def _stream(parts: Iterator[pa.RecordBatch], columns: Columns, open_: list, n: int, what: str) -> None:
    """One pass over a frame: each batch goes to all of its datasets."""
    for batch in parts:
        for d, c, part, dtype in open_:
            d.add(columns.values(batch.column(batch.schema.get_field_index(c)), c, part, dtype))
    for d, c, *_ in open_:
        if (got := d.close()) != n:
            raise DataError(f"{what}/{c}: {got} rows for {n} places")


def _put(w: Writer, key: str, value: np.ndarray, attributes: dict) -> None:
    text = value.dtype == object
    w.dataset(key, [value.reshape(-1).tolist() if text else value], list(value.shape), "string" if text else "bool" if value.dtype == bool else value.dtype.str, attributes)


def _piece(rows: list[tuple[str, str]], top: str) -> pa.RecordBatch:
    """rows in order. What the first and the last one are in may go on in other pieces and stays open."""
    w = Segment(SMALL if len(rows) > 500 else 4096)
    first = rows[0][0].split("/")[:-1]
    open_ = {"/".join([top, *first[:k]]) for k in range(len(first) + 1)}
    write_uns(rows, w.group, lambda key, value, attributes: _put(w, key, value, attributes), top, lambda key: key in open_ or w.finish(key))
    return pa.record_batch([pa.array([x]) for x in w.close()], ["raw", "addresses", "nodes"])


def _uns(w: Writer, c: Container, top: str) -> None:
    """Tasks make the metadata's nodes in pieces; the file takes them as they are."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if len(held) >= PIECE or held and size + len(row[1]) > LENGTH:
                    yield _piece(held, top)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield _piece(held, top)

    w.group(top, {"encoding-type": "dict", "encoding-version": "0.1.0"})
    place = F.split("path", "/")  # what is in a group stands together
    rows = c.uns.select("path", "value").repartitionByRange(int(c.spark.conf.get("spark.sql.shuffle.partitions")), place).sortWithinPartitions(place)
    pieces = rows.mapInArrow(make, "raw binary, addresses binary, nodes string").persist(StorageLevel.DISK_ONLY)
    try:
        pieces.count()  # all at once; an iterator alone would have one made after another
        for r in pieces.toLocalIterator(prefetchPartitions=True):
            w.take(zlib.decompress(r.raw), np.cumsum(np.frombuffer(zlib.decompress(r.addresses), "<u4"), dtype=np.int64), *json.loads(r.nodes))
    finally:
        pieces.unpersist()
    write_spatial(c.tables, w.group, lambda key, value, attributes: _put(w, key, value, attributes), w.grow, batches, f"{top}/spatial")


def _anndata(w: Writer, c: Container, at: str = "") -> None:
    """X, layers, obs, var, obsm, varm, obsp, varp and uns under a prefix."""
    w.group(at.rstrip("/"), {"encoding-type": "anndata", "encoding-version": "0.1.0"})
    for top in ("layers", "obsm", "varm", "obsp", "varp"):
        w.group(f"{at}{top}", {"encoding-type": "dict", "encoding-version": "0.1.0"})
    # all tables are on their way while the file takes one after another
    tables = ((all_matrices(c, at), ("name", "i", "j")), (c.obs, ("obs_idx",)), (c.var, ("var_idx",)), (all_vectors(c, at), ("name", "i")))
    matrices, obs, var, vectors = (ahead(c.spark, batches(df, *order)) for df, order in tables)
    seen_obs, seen_var, sizes = at_once(c.spark, lambda: Columns(c.obs, "obs", c.levels), lambda: Columns(c.var, "var", c.levels), lambda: vector_shapes(c, at))
    _matrices(w, matrices, c.shape, at)
    _frame(w, "obs", seen_obs, obs, c.shape[0], at)
    _frame(w, "var", seen_var, var, c.shape[1], at)
    _vectors(w, vectors, sizes)
    _uns(w, c, f"{at}uns")


def write_h5ad(c: Container, path: str, overwrite: bool = False, level: int = 0, raw: Container | None = None) -> None:
    """The file appears when it is complete. level: of deflate. raw: cells of the same order with features of its own,
    whose X and var go to raw."""
    with Writer(_target(path, overwrite), level) as w:
        _anndata(w, c)
        if raw is not None:
            own = Container.of(raw.spark, raw.shape, matrix=raw.matrix.filter("layer = 'X'"))
            _matrices(w, batches(all_matrices(own, "raw/"), "name", "i", "j"), raw.shape, "raw/")
            _whole_frame(w, "var", raw.var, raw.shape[1], raw.levels, "raw/")


def read_h5mu(spark: SparkSession, path: str, modalities: list[str] | None = None, **options) -> dict[str, Container]:
    """One lazy container for each modality, in mod-order."""
    tree = Tree(path)
    there = tree.attrs("mod").get("mod-order") or tree.children("mod")
    if not there:
        raise DataError(f"{path} has no modalities")
    if missing := [m for m in modalities or [] if m not in there]:
        raise DataError(f"{path} has no modalities {missing}; there are {there}")
    return {m: read_tree(spark, path, prefix=f"mod/{m}", **options) for m in there if modalities is None or m in modalities}


def write_h5mu(mods: dict[str, Container], path: str, overwrite: bool = False, level: int = 0) -> None:
    """Modalities of the same cells, with global obs and var and the maps between global and local positions."""
    first = next(iter(mods.values()))
    n = first.shape[0]
    for m, c in mods.items():
        if c is first:
            continue
        moved = c.obs.select(F.col("obs_idx").alias("i"), F.col("obs_id").alias("x")).join(first.obs, F.col("i") == F.col("obs_idx"), "full").filter(~F.col("x").eqNullSafe(F.col("obs_id")))
        if c.shape[0] != n or not moved.isEmpty():
            raise DataError(f"modality {m} has other cells, or in another order")
    with Writer(_target(path, overwrite), level) as w:
        w.group("", {"encoding-type": "MuData", "encoding-version": "0.1.0"})
        w.group("mod", {"mod-order": list(mods)})
        for m, c in mods.items():
            _anndata(w, c, f"mod/{m}/")
        _whole_frame(w, "obs", first.obs.select("obs_idx", "obs_id"), n, first.levels)
        total, start, var = sum(c.shape[1] for c in mods.values()), 0, None
        twice = None
        for c in mods.values():
            names = c.var.select("var_id").distinct()
            twice = names if twice is None else twice.unionByName(names)
        twice = twice.groupBy("var_id").count().filter("count > 1").select(F.col("var_id").alias("d"))
        for m, c in mods.items():
            own = c.var.join(twice, F.col("var_id") == F.col("d"), "left").select((F.col("var_idx") + start).alias("var_idx"), F.when(F.col("d").isNotNull(), F.concat(F.lit(f"{m}:"), "var_id")).otherwise(F.col("var_id")).alias("var_id"))
            var = own if var is None else var.unionByName(own)
            p = c.shape[1]
            for key, size, low, high in ((f"obsmap/{m}", n, 0, n), (f"varmap/{m}", total, start, start + p)):
                d = w.grow(key, "<i8")
                for a in range(0, size, PART):
                    at = np.arange(a, min(size, a + PART))
                    d.add(np.where((at >= low) & (at < high), at - low, -1))
                d.close()
            start += p
        _whole_frame(w, "var", var, total, first.levels.limit(0))


def _seurat_frame(w: Writer, top: str, key: str, names: str, df: DataFrame, n: int, levels: DataFrame) -> None:
    """Names in one dataset and columns in a group: factors as 1-based values and levels, logicals as 0, 1 and 2 for null;
    other nulls are noted beside."""
    columns = Columns(df, top, levels)
    w.group(key, {"colnames": list(columns.names)})
    open_ = []
    for at, c, part, dtype in columns.plan:
        if at == "_index":
            open_.append((w.grow(names, "string"), c, part, dtype))
        elif c in columns.labels and part == "codes":
            w.group(f"{key}/{c}", {"ordered": columns.ordered[c]})
            w.dataset(f"{key}/{c}/levels", [columns.labels[c]], [len(columns.labels[c])], "string")
            open_.append((_Shifted(w.grow(f"{key}/{c}/values", "<i4")), c, part, "<i4"))
        elif dtype == "bool" and part == "value":
            open_.append((_Logical(w.grow(f"{key}/{c}", "<i4", (), {"s3class": "logical"})), c, "whole", dtype))
        elif part == "mask" and dict(df.dtypes)[c] == "boolean":
            continue  # the 2 says it
        else:
            open_.append((w.grow(f"{key}/{c}" if part == "value" else f"{views.NULLS}/{key}/{c}", dtype), c, part, dtype))
    for batch in batches(df, columns.index):
        for d, c, part, dtype in open_:
            column = batch.column(batch.schema.get_field_index(c))
            d.add(column if part == "whole" else columns.values(column, c, part, dtype))
    for d, c, *_ in open_:
        if (got := d.close()) != n:
            raise DataError(f"{key}/{c}: {got} rows for {n} places")


class _Shifted:
    """0-based codes to 1-based values; null is 0."""

    def __init__(self, inner):
        self.inner, self.close = inner, inner.close

    def add(self, codes: np.ndarray) -> None:
        self.inner.add(codes.astype(np.int64) + 1)


class _Logical:
    def __init__(self, inner):
        self.inner, self.close = inner, inner.close

    def add(self, flags: pa.Array) -> None:
        self.inner.add(np.array([2 if v is None else int(v) for v in flags.to_pylist()]))


def write_h5seurat(c: Container, path: str, overwrite: bool = False, assay: str = "RNA", level: int = 0, nested: bool = False) -> None:
    """Features x cells by columns, which is our rows x features by rows; X is the layer data. nested: layers stand in a
    group of their own, as newer files have them."""
    n, p = c.shape
    at = f"assays/{assay}"
    with Writer(_target(path, overwrite), level) as w:
        w.group("", {"version": "3.1.5.9900", "project": str(c.attrs.get("project", "cellmill")), "active.assay": assay})
        w.group(at, {"key": f"{assay.lower()}_"})
        _seurat_frame(w, "obs", "meta.data", "cell.names", c.obs, n, c.levels)
        _seurat_frame(w, "var", f"{at}/meta.features", f"{at}/features", c.var, p, c.levels)

        def place(name: str) -> tuple[str, dict]:
            top, _, own = name.partition("/")
            if top in ("X", "layers"):
                stored = "data" if top == "X" else {"scaled": "scale.data", "data": "data.layer"}.get(own, own)
                return f"{at}/layers/{stored}" if nested else f"{at}/{stored}", {"dims": [p, n]} | ({"layer": own} if own else {})
            return (f"graphs/{own}" if top == "obsp" else f"{at}/misc/varp/{own}"), {"key": own, "assay.used": assay}

        _matrices(w, batches(all_matrices(c), "name", "i", "j"), c.shape, place=place)
        sizes = vector_shapes(c)
        places = {}
        loadings = {k: r for r, k in ((r, views.M.LOADINGS_OUT.get(r, r.upper())) for r in (x.partition("/")[2].removeprefix("X_") for x in sizes if x.startswith("obsm/")))}
        for name in sizes:
            top, _, own = name.partition("/")
            reduction = own.removeprefix("X_") if top == "obsm" else loadings.get(own, own)
            w.group(f"reductions/{reduction}", {"active.assay": assay, "key": f"{views.M.REDUCTION_KEYS.get(reduction.lower(), reduction.upper() + '_')}", top: own})
            places[name] = f"reductions/{reduction}/{'cell.embeddings' if top == 'obsm' else 'feature.loadings'}"
        if len(set(places.values())) < len(places):
            raise DataError(f"embeddings {sorted(sizes)} would have one name in the file")
        _vectors(w, batches(all_vectors(c), "name", "i"), sizes, places)
        _uns(w, c, "misc")


def read_h5seurat(spark: SparkSession, path: str, components: Iterable[str] | None = None, assay: str | None = None, **options) -> Container:
    """One assay: layers, cell and feature tables, reductions with loadings, graphs, misc."""
    return read_tree(spark, path, components, view="h5seurat", assay=assay, **options)


def is_nested(path: str) -> bool:
    """Whether an h5Seurat file keeps its layers in a group of their own."""
    tree = Tree(path)
    return any(tree.kind(f"assays/{a}/layers") == "group" for a in tree.children("assays"))


def gef_expression(spark: SparkSession, path: str, key: str, columns: dict[str, str], step: int = 1 << 18) -> DataFrame:
    """pos and columns (name -> field) of a table of records, read by the executors in ranges."""
    tree = Tree(path)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in part.column(0).to_pylist():
                e = tree.array(key).read(begin, begin + step)
                yield pa.record_batch([pa.array(np.arange(len(e)) + begin), *[pa.array(e[f].astype(np.int64)) for f in columns.values()]], ["pos", *columns])

    return spark.range(0, tree.array(key).shape[0], step).mapInArrow(read, ", ".join(f"{c} long" for c in ("pos", *columns)))


def _names(records: np.ndarray, fields: tuple[str, ...]) -> list[str]:
    label = next(f for f in fields if f in records.dtype.names)
    return [x.split(b"\0")[0].decode() for x in records[label].tolist()]


def read_gef(spark: SparkSession, path: str, bin_size: int = 50) -> Container:
    """Stereo-seq square bins: run lengths of genes over rows (x, y, count)."""
    from .vendor import square_bins

    tree = Tree(path)
    at = f"geneExp/bin{bin_size}"
    if tree.kind(f"{at}/gene") != "array" or tree.kind(f"{at}/expression") != "array":
        raise DataError(f"{path} has no bin{bin_size}; there are {tree.children('geneExp')}")
    g = tree.array(f"{at}/gene").read()
    names = _names(g, ("geneName", "gene", "geneID"))
    genes = spark.createDataFrame([(k, int(x["offset"]), int(x["count"])) for k, x in enumerate(g)], "gene long, offset long, count long")
    spots, sums = square_bins(genes, gef_expression(spark, path, f"{at}/expression", {"x": "x", "y": "y", "n": "count"}))
    obs = spots.select(F.col("spot").alias("obs_idx"), F.col("spot_id").alias("obs_id"), "x", "y")
    matrix = sums.select(F.lit("X").alias("layer"), F.col("spot").alias("obs_idx"), F.col("gene").alias("var_idx"), F.col("value").cast("double"))
    return Container.of(spark, (obs.count(), len(names)), {"format": "gef", "bin_size": bin_size}, obs=obs, var=spark.createDataFrame(list(enumerate(names)), "var_idx long, var_id string"), matrix=matrix)


def read_cellbin_gef(spark: SparkSession, path: str) -> Container:
    """Stereo-seq cell bins: each cell has a run of (gene, count) records."""
    from .vendor import cell_bins

    tree = Tree(path)
    for k in ("cell", "cellExp", "gene"):
        if tree.kind(f"cellBin/{k}") != "array":
            raise DataError(f"{path} has no cellBin/{k}")
    names = _names(tree.array("cellBin/gene").read(), ("geneName", "gene", "geneID"))
    fields = tree.array("cellBin/cell").dtype.names
    kept = {c: f for c, f in (("offset", "offset"), ("gene_count", "geneCount"), ("x", "x"), ("y", "y"), ("area", "area")) if f in fields}
    cells = gef_expression(spark, path, "cellBin/cell", kept).withColumnRenamed("pos", "cell")
    shown = tree.array("cellBin/cellExp").dtype.names
    expression = gef_expression(spark, path, "cellBin/cellExp", {"gene": next(f for f in ("geneID", "gene") if f in shown), "n": "count"})
    sums = cell_bins(cells, expression)
    obs = cells.select(F.col("cell").alias("obs_idx"), F.format_string("cell_%d", "cell").alias("obs_id"), *[c for c in ("x", "y", "area") if c in kept])
    matrix = sums.select(F.lit("X").alias("layer"), F.col("cell").alias("obs_idx"), F.col("gene").alias("var_idx"), F.col("value").cast("double"))
    n = tree.array("cellBin/cell").shape[0]
    return Container.of(spark, (n, len(names)), {"format": "cellbin.gef"}, obs=obs, var=spark.createDataFrame(list(enumerate(names)), "var_idx long, var_id string"), matrix=matrix)


def _dense(w: Writer, c: Container) -> None:
    """Layers as dense genes x cells, in tiles that tasks deflate; a tile without entries takes no room."""
    n, p = c.shape
    open_ = {"X": Tiles(w, "matrix", (p, n))}
    tile, level = open_["X"].tile, max(1, w.level)
    at = c.matrix.select("layer", F.floor(F.col("var_idx") / tile[0]).alias("r"), F.floor(F.col("obs_idx") / tile[1]).alias("c"), "var_idx", "obs_idx", F.col("value").cast("double").alias("value"))

    def deflate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def flush() -> pa.RecordBatch:
            whole = np.zeros(tile)
            for i, j, v in held:
                whole[i, j] = v
            held.clear()
            return pa.record_batch([pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([place[2]], pa.int64()), pa.array([zlib.compress(whole.tobytes(), level)], pa.binary())], ["layer", "r", "c", "raw"])

        for part in parts:
            if not part.num_rows:
                continue
            names = part.column(0).dictionary_encode()
            codes = np.asarray(names.indices)
            r, col, i, j, v = (np.asarray(part.column(k)) for k in range(1, 6))
            new = (codes[1:] != codes[:-1]) | (r[1:] != r[:-1]) | (col[1:] != col[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(r)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = (names.dictionary[int(codes[a])].as_py(), int(r[a]), int(col[a]))
                if place is not None and own != place:
                    yield flush()
                place = own
                held.append((i[a:b] - own[1] * tile[0], j[a:b] - own[2] * tile[1], v[a:b]))
        if place is not None:
            yield flush()

    # rows of a tile are in one partition, as it is dealt out by the tile's place; the file's index is sorted at its end
    place = ("layer", "r", "c")
    tiles = at.repartition(int(c.spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place)
    tiles = tiles.mapInArrow(deflate, "layer string, r long, c long, raw binary").persist(StorageLevel.DISK_ONLY)
    try:
        tiles.count()  # all at once; an iterator alone would have one partition made after another
        for row in tiles.toLocalIterator(prefetchPartitions=True):
            if row.layer not in open_:
                open_[row.layer] = Tiles(w, f"layers/{row.layer}", (p, n))
            open_[row.layer].put(row.r * tile[0], row.c * tile[1], bytes(row.raw))
    finally:
        tiles.unpersist()
    for d in open_.values():
        d.close()


def write_loom(c: Container, path: str, overwrite: bool = False, level: int = 0) -> None:
    """Loom 3: dense layers of genes x cells, attributes (embeddings are those of two dimensions), graphs as edges; levels
    of factors, nulls and unstructured metadata, for which Loom has no place, stand beside."""
    n, p = c.shape
    with Writer(_target(path, overwrite), level) as w:
        w.group("", {"LOOM_SPEC_VERSION": "3.0.0"})
        for g in ("layers", "row_attrs", "col_attrs", "row_graphs", "col_graphs", "attrs"):
            w.group(g)
        w.dataset("attrs/LOOM_SPEC_VERSION", [["3.0.0"]], [1], "string")
        _dense(w, c)
        none = c.levels.limit(0)
        for top, file, df, name, size in (("var", "row_attrs", c.var, "Gene", p), ("obs", "col_attrs", c.obs, "CellID", n)):
            columns = Columns(df, top, none)
            if name in columns.names:
                raise DataError(f"{top} has a column {name}, which is where Loom keeps its names")
            w.group(file, {"colnames": list(columns.names)})
            open_ = [(w.grow(f"{file}/{name}" if at == "_index" else f"{file}/{k}" if part == "value" else f"{views.NULLS}/{file}/{k}", dtype), k, part, dtype) for at, k, part, dtype in columns.plan]
            _stream(batches(df, columns.index), columns, open_, size, file)
        shapes = vector_shapes(c)
        _vectors(w, batches(all_vectors(c), "name", "i"), shapes, {k: k.replace("obsm/", "col_attrs/").replace("varm/", "row_attrs/") for k in shapes})
        for top, file in (("obsp", "col_graphs"), ("varp", "row_graphs")):
            at, open_ = None, []
            for part in batches(c.tables[top].select("key", "i", "j", F.col("w").cast("double").alias("w")), "key", "i", "j"):
                keys = part.column(0).to_pylist()
                cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if keys[a] != at:
                        for d in open_:
                            d.close()
                        at, open_ = keys[a], [w.grow(f"{file}/{keys[a]}/{x}", t) for x, t in (("a", "<i8"), ("b", "<i8"), ("w", "<f8"))]
                    for d, k in zip(open_, (1, 2, 3), strict=True):
                        d.add(np.asarray(part.column(k))[a:b])
            for d in open_:
                d.close()
        labels: dict[tuple[str, str], list] = {}
        for r in c.levels.orderBy("tbl", "col", "code").toLocalIterator():
            labels.setdefault((r.tbl, r.col), []).append(r)
        for (tbl, col), own in labels.items():
            w.dataset(f"attrs/levels/{tbl}/{col}", [[r.label for r in own]], [len(own)], "string", {"ordered": bool(own[0].ordered)})
        _uns(w, c, "attrs/uns")


def read_loom(spark: SparkSession, path: str, components: Iterable[str] | None = None, genes: str = "Gene", cells: str = "CellID", valid_only: bool = False, **options) -> Container:
    """Dense layers by ranges of genes, read by the executors; attributes as columns and embeddings. valid_only: keep rows
    and columns whose Valid attribute is 1."""
    c = read_tree(spark, path, components, view="loom", genes=genes, cells=cells, **options)
    return keep_valid(c) if valid_only else c


def keep_valid(c: Container) -> Container:
    from ..operators.joins import valid_rows
    from ..operators.order import positions

    tables, shape = dict(c.tables), list(c.shape)
    for k, (axis, pairs, vectors) in enumerate((("obs", "obsp", "obsm"), ("var", "varp", "varm"))):
        own, idx = tables[axis], f"{axis}_idx"
        if "Valid" not in own.columns:
            continue
        good = F.col("Valid") == 1
        for t in ("matrix", vectors):
            tables[t] = valid_rows(tables[t], own, idx, good).withColumnRenamed("new_idx", idx).select(*tables[t].columns)
        for end in ("i", "j"):
            axis_of = own.withColumnRenamed(idx, end)
            tables[pairs] = valid_rows(tables[pairs], axis_of, end, good).withColumnRenamed("new_idx", end).select(*tables[pairs].columns)
        tables[axis] = positions(own.filter(good), idx, out="__new").drop(idx).withColumnRenamed("__new", idx).select(*own.columns)
        shape[k] = tables[axis].count()
    return Container(c.spark, tables, tuple(shape), c.attrs)
