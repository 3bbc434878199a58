"""The hub: a labelled dataset as lazy DataFrames, and its native Parquet form.

obs / var: obs_idx | var_idx, obs_id | var_id, columns. matrix: layer, obs_idx, var_idx, value. obsm: key, obs_idx, vec.
varm: key, var_idx, vec. obsp / varp: key, i, j, w. uns: path, value (JSON). levels: tbl, col, code, label, ordered.
Positions are explicit, for rows have no order of their own. Nothing is read before an action asks for it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import DataError, append, overlay
from ..operators.multimodal import reduction_names, reduction_stem

SCHEMAS = {
    "obs": "obs_idx long, obs_id string", "var": "var_idx long, var_id string", "matrix": "layer string, obs_idx long, var_idx long, value double", "obsm": "key string, obs_idx long, vec array<double>",
    "varm": "key string, var_idx long, vec array<double>", "obsp": "key string, i long, j long, w double", "varp": "key string, i long, j long, w double", "uns": "path string, value string",
    "levels": "tbl string, col string, code long, label string, ordered boolean",
}


@dataclass
class Container:
    spark: SparkSession
    tables: dict[str, DataFrame]
    shape: tuple[int, int]
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, shape: tuple[int, int], attrs: dict | None = None, **tables: DataFrame) -> Container:
        whole = {n: tables.get(n) if tables.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return cls(spark, whole, shape, attrs or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)

    def only(self, components: Iterable[str] | None) -> Container:
        """Component projection; the matrix's X is always there."""
        if components is None:
            return self
        keep = {*components, "obs", "var"}
        tables = {n: t if n in keep else t.limit(0) for n, t in self.tables.items()}
        tables["matrix"] = self.matrix if "layers" in keep or "matrix" in keep else self.matrix.filter("layer = 'X'")
        return replace(self, tables=tables)

    def layers(self) -> list[str]:
        return sorted(r.layer for r in self.matrix.select("layer").distinct().collect())

    def keys(self, table: str) -> list[str]:
        return sorted(r.key for r in self.tables[table].select("key").distinct().collect())

    def cells(self) -> DataFrame:
        return self.obs.select("obs_idx", "obs_id")

    def features(self) -> DataFrame:
        return self.var.select("var_idx", "var_id")

    @property
    def default_assay(self) -> str:
        return self.attrs.get("assay", "RNA")

    def counts(self) -> DataFrame:
        """obs_idx, var_idx, value of the counts: their own layer, or X where that holds them."""
        layer = "X" if self.attrs.get("x_holds") == "counts" or self.matrix.filter("layer = 'counts'").isEmpty() else "counts"
        return self.matrix.filter(F.col("layer") == layer).drop("layer")

    def reductions(self) -> dict[str, str]:
        """Name of each reduction -> its key among the embeddings."""
        return dict(zip(reduction_names(keys := [k for k in self.keys("obsm") if reduction_stem(k) != "spatial"]), keys, strict=True))

    def query(self, obs_query: str | None = None, var_query: str | None = None, obs_columns: list[str] | None = None, var_columns: list[str] | None = None) -> Container:
        """Rows by predicates on obs and var, and their columns. Predicates reach the scans of these tables; matrix,
        embeddings and graphs keep the rows that are left, by semi-joins. Positions stay."""
        obs, var = (self.obs.filter(obs_query) if obs_query else self.obs), (self.var.filter(var_query) if var_query else self.var)
        tables = dict(self.tables)
        for axis, asked, left, vectors, graphs in (("obs", obs_query, obs, "obsm", "obsp"), ("var", var_query, var, "varm", "varp")):
            if asked:
                ids = left.select(f"{axis}_idx")
                tables |= {t: tables[t].join(ids, f"{axis}_idx", "left_semi") for t in ("matrix", vectors)}
                tables[graphs] = tables[graphs].join(ids.withColumnRenamed(f"{axis}_idx", "i"), "i", "left_semi").join(ids.withColumnRenamed(f"{axis}_idx", "j"), "j", "left_semi")
        tables["obs"] = obs.select("obs_idx", "obs_id", *obs_columns) if obs_columns is not None else obs
        tables["var"] = var.select("var_idx", "var_id", *var_columns) if var_columns is not None else var
        return replace(self, tables=tables)

    def append(self, other: Container, components: Iterable[str] = ("layers", "obsm", "varm", "obsp", "varp", "uns"), overwrite: bool = False) -> Container:
        """This container with what other has and it lacks (or, overwriting, with all that other has). Cells must be the
        same ones in the same order; so must features, where entries of features are taken."""
        for axis, k in (("obs", 0), ("var", 1)):
            if axis == "var" and not {"layers", "varm", "varp"} & {*components}:
                continue
            ids = lambda c, as_: c.tables[axis].select(F.col(f"{axis}_idx").alias(as_), F.col(f"{axis}_id").alias(f"{as_}_id"))  # noqa: E731,B023
            moved = ids(self, "a").join(ids(other, "b"), F.col("a") == F.col("b"), "full").filter(~F.col("a_id").eqNullSafe(F.col("b_id")))
            if self.shape[k] != other.shape[k] or not moved.isEmpty():
                raise DataError(f"the two have other {'cells' if axis == 'obs' else 'features'}, or in another order")
        tables = dict(self.tables)
        for part in components:
            name, key = {"layers": ("matrix", "layer"), "uns": ("uns", "path")}.get(part, (part, "key"))
            tables[name] = append(self.tables[name], other.tables[name], key, overwrite)
        return replace(self, tables=tables)

    def load_more(self, path: str, components: Iterable[str], **options) -> Container:
        """This container with further components of a file; obs columns come by position, the file's count."""
        from . import formats

        more = formats.load(self.spark, path, components=components, **options)
        out = self.append(more, [c for c in components if c not in ("obs", "var")], overwrite=True) if {*components} - {"obs", "var"} else self
        tables = dict(out.tables)
        for axis in ("obs", "var"):
            if axis in components:
                tables[axis] = overlay(self.tables[axis], more.tables[axis], f"{axis}_idx")
        return replace(out, tables=tables)


def fs_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reaches; empty if it is none."""
    at, fs = fs_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) and fs.getFileStatus(at).isDirectory() else []


def replace_dir(spark: SparkSession, path: str, overwrite: bool):
    """A temporary sibling to write to, and a function that puts it in place. An existing target is an error unless
    overwrite is set; it steps aside when the new one is complete, and goes when that is in place."""
    at, fs = fs_of(spark, path)
    if fs.exists(at) and not overwrite:
        raise DataError(f"{path} exists; set overwrite to replace it")
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"

    def commit() -> None:
        old = fs_of(spark, f"{tmp}.old")[0]
        there = fs.exists(at) and fs.rename(at, old)
        if not fs.rename(fs_of(spark, tmp)[0], at):
            if there:
                fs.rename(old, at)
            raise DataError(f"{tmp} can't be renamed to {path}")
        if there:
            fs.delete(old, True)

    return tmp, commit


def write_container(c: Container, path: str, overwrite: bool = False, compression: str = "zstd", level: int | None = None) -> None:
    """Parquet tables, the matrix partitioned by layer and sorted by row, then a manifest; atomic. Level 0 stores as it
    is. The tables are written side by side."""
    tmp, commit = replace_dir(c.spark, path, overwrite)
    codec = "none" if level == 0 else compression

    def write(item: tuple[str, DataFrame]) -> None:
        name, df = item
        if name == "matrix":
            # a part's rows are of one range of rows, so that row groups can be skipped
            df.repartitionByRange("layer", "obs_idx").sortWithinPartitions("layer", "obs_idx", "var_idx").write.option("compression", codec).partitionBy("layer").parquet(f"{tmp}/{name}")
        else:
            df.write.option("compression", codec).parquet(f"{tmp}/{name}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(inheritable_thread_target(c.spark)(write), c.tables.items()))
    manifest = json.dumps({"version": 1, "shape": list(c.shape), "attrs": c.attrs, "schemas": {n: d.schema.json() for n, d in c.tables.items()}})
    c.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{tmp}/manifest")
    commit()


def read_container(spark: SparkSession, path: str, components: Iterable[str] | None = None, obs_query: str | None = None, var_query: str | None = None, obs_columns: list[str] | None = None, var_columns: list[str] | None = None) -> Container:
    from pyspark.sql.types import StructType

    facts = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    tables = {}
    for name, schema in facts["schemas"].items():
        want = StructType.fromJson(json.loads(schema))
        tables[name] = spark.read.schema(want).parquet(f"{path}/{name}").select(want.names)
    return Container(spark, tables, tuple(facts["shape"]), facts["attrs"]).only(components).query(obs_query, var_query, obs_columns, var_columns)


def from_memory(spark: SparkSession, assays: dict[str, object], obs=None, var=None, obsm: dict[str, object] | None = None) -> Container:
    """A container of what a session holds: assays are arrays or sparse matrices of features x cells, obs and var pandas
    frames with names as index, obsm arrays of cells x dimensions. logcounts are X and counts a layer; without logcounts
    the counts are X, without either the first assay is."""
    import numpy as np
    import pandas as pd

    main = "logcounts" if "logcounts" in assays else "counts" if "counts" in assays else next(iter(assays))
    p, n = assays[main].shape
    frames = {}
    for axis, frame, size, stem in (("obs", obs, n, "Cell"), ("var", var, p, "Gene")):
        frame = pd.DataFrame(index=[f"{stem}{k + 1}" for k in range(size)]) if frame is None else frame
        if len(frame) != size:
            raise DataError(f"{axis} has {len(frame)} rows, the assays have {size}")
        named = frame.copy()
        named.insert(0, f"{axis}_id", [str(x) for x in frame.index])
        named.insert(0, f"{axis}_idx", np.arange(size))
        frames[axis] = spark.createDataFrame(named.reset_index(drop=True))
    parts = []
    for name, values in assays.items():
        if values.shape != (p, n):
            raise DataError(f"assay {name} is {values.shape}, {main} is {(p, n)}")
        if hasattr(values, "tocoo"):
            coo = values.tocoo()
            g, o, v = coo.row, coo.col, coo.data
        else:
            g, o = np.nonzero(np.asarray(values))
            v = np.asarray(values)[g, o]
        parts.append(pd.DataFrame({"layer": "X" if name == main else name, "obs_idx": o.astype("int64"), "var_idx": g.astype("int64"), "value": v.astype(float)}))
    matrix = spark.createDataFrame(pd.concat(parts), SCHEMAS["matrix"])
    vectors = [(k, i, [float(x) for x in row]) for k, rows in (obsm or {}).items() for i, row in enumerate(np.asarray(rows))]
    facts = {"x_holds": "counts" if main == "counts" else "data", "counts_from": "layers/counts" if main == "logcounts" and "counts" in assays else "X"}
    return Container.of(spark, (n, p), facts, obs=frames["obs"], var=frames["var"], matrix=matrix, obsm=spark.createDataFrame(vectors, SCHEMAS["obsm"]))


def from_tables(spark: SparkSession, sf_dir: str) -> Container:
    """The container that plans.derive makes of the star-schema tables."""
    from ..plans import derive

    o, v, x = derive.obs(spark, sf_dir), derive.var(spark, sf_dir), derive.coo(spark, sf_dir)
    matrix = x.select(F.lit("X").alias("layer"), "obs_idx", "var_idx", F.col("value").cast("double"))
    e = derive.table(spark, sf_dir, "embeddings")
    obsm = o.select("obs_idx").join(e, F.col("obs_idx") == F.col("vec_id")).select(F.lit("X_pca").alias("key"), "obs_idx", F.col("embedding").cast("array<double>").alias("vec"))
    obs = o.select("obs_idx", "obs_id", "grp", "s_acctbal")
    var = v.select("var_idx", "var_id", "brand", "highly_variable", F.col("p_size").cast("long").alias("p_size"))
    cells = derive.table(spark, sf_dir, "supplier").join(derive.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return Container.of(spark, (cells.count(), derive.table(spark, sf_dir, "part").count()), obs=obs, var=var, matrix=matrix, obsm=obsm)
