"""Queries that write the derived container in a format and read it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.joins import DataError
from ..operators.order import positions
from ..sources import formats
from ..sources.container import Container, from_tables
from .derive import table
from .queries import query

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise DataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cellmill-")
        _made.append(folder)
    return f"{folder}/{uuid.uuid4().hex}{name}"


@atexit.register
def _clean() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


def _there_and_back(spark, d, name, **options):
    path = scratch(spark, name)
    formats.save(from_tables(spark, d), path, **options)
    return formats.load(spark, path)


def _matrix(c):
    return c.matrix.select("obs_idx", "var_idx", F.col("value").cast("long").alias("value"))


@query("select obs_idx, var_idx, value from coo")
def q_container_roundtrip(spark, d):
    return _matrix(_there_and_back(spark, d, ".parquet"))


@query("select obs_idx, var_idx, value from coo")
def q_zarr_roundtrip(spark, d):
    return _matrix(_there_and_back(spark, d, ".zarr"))


@query("select obs_idx, var_idx, value from coo where obs_idx between 10 and 19 and var_idx % 7 = 0")
def q_zarr_slice(spark, d):
    c = _there_and_back(spark, d, ".zarr", version=3, codec="zstd")
    return _matrix(c).filter("obs_idx between 10 and 19 and var_idx % 7 = 0")


@query("select obs_idx, var_idx, value from coo")
def q_h5ad_roundtrip(spark, d):
    return _matrix(_there_and_back(spark, d, ".h5ad"))


@query("select obs_idx, obs_id, grp from obs")
def q_h5ad_obs(spark, d):
    return _there_and_back(spark, d, ".h5ad").obs.select("obs_idx", "obs_id", "grp")


@query("select vec_id as obs_idx, k::bigint - 1 as dim, round(embedding[k]::double, 6) as value from embeddings join obs on vec_id = obs_idx, range(1, 65) r(k)")
def q_h5ad_obsm(spark, d):
    c = _there_and_back(spark, d, ".h5ad")
    e = c.obsm.select("obs_idx", F.posexplode("vec").alias("dim", "value")).filter("not isnan(value)")
    return e.select("obs_idx", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("select obs_idx, var_idx, value from coo")
def q_h5seurat_roundtrip(spark, d):
    return _matrix(_there_and_back(spark, d, ".h5seurat"))


@query("select obs_idx, var_idx, value from coo where obs_idx in (select obs_idx from obs where s_acctbal > 1000)")
def q_container_query(spark, d):
    path = scratch(spark, ".parquet")
    formats.save(from_tables(spark, d), path)
    return _matrix(formats.load(spark, path, obs_query="s_acctbal > 1000"))


def _rich(spark, d):
    """The derived container with a layer, columns with nulls, loadings, graphs and unstructured metadata."""
    c = from_tables(spark, d)
    counts = c.matrix.withColumn("layer", F.lit("counts"))
    x = c.matrix.withColumn("value", F.round(F.log1p("value"), 6))
    var = c.var.withColumns({"p_size": F.when(F.col("p_size") % 4 != 0, F.col("p_size")), "brand": F.when(F.col("p_size") % 5 != 0, F.col("brand"))})
    varm = var.select(F.lit("PCs").alias("key"), "var_idx", F.array(F.col("var_idx").cast("double"), (F.col("var_idx") / 2)).alias("vec"))
    varp = var.select(F.lit("near").alias("key"), F.col("var_idx").alias("i"), F.floor(F.col("var_idx") / 2).alias("j"), (F.col("var_idx") * 0.5).alias("w"))
    obsp = c.obs.select(F.lit("connectivities").alias("key"), F.col("obs_idx").alias("i"), F.floor(F.col("obs_idx") / 3).alias("j"), (F.col("obs_idx") + 0.25).alias("w"))
    uns = table(spark, d, "nation").select(F.concat(F.lit("nations/"), "n_name").alias("path"), F.to_json(F.struct(F.array("n_nationkey", "n_regionkey").alias("v"))).alias("value"))
    uns = uns.select("path", F.get_json_object("value", "$.v").alias("value"))
    return Container(spark, c.tables | {"matrix": x.unionByName(counts), "var": var, "varm": varm, "varp": varp, "obsp": obsp, "uns": uns}, c.shape, c.attrs)


_PARTS = """
select 'matrix ' || layer as part, obs_idx as i, var_idx as j, value::varchar as value from (select 'X' as layer, obs_idx, var_idx, round(ln(1 + value), 6) as value from coo union all select 'counts', obs_idx, var_idx, value::double from coo)
union all select 'var', var_idx, null, coalesce(case when p_size % 5 <> 0 then brand end, '-') || '/' || coalesce(case when p_size % 4 <> 0 then p_size end::varchar, '-') || '/' || highly_variable::varchar from var
union all select 'obs', obs_idx, null, obs_id || '/' || grp from obs
union all select 'varm PCs', var_idx, k, case k when 0 then var_idx::double else var_idx / 2 end::varchar from var, range(0, 2) r(k)
union all select 'varp near', var_idx, var_idx // 2, (var_idx * 0.5)::double::varchar from var where var_idx > 0
union all select 'obsp connectivities', obs_idx, obs_idx // 3, (obs_idx + 0.25)::double::varchar from obs
union all select 'uns nations/' || n_name, 0, k, [n_nationkey, n_regionkey][k + 1]::varchar from nation, range(0, 2) r(k)"""


def _parts(c):
    """All parts of a container as rows (part, i, j, value)."""
    text = lambda v: F.col(v).cast("string").alias("value")
    none = F.lit(None).cast("long").alias("j")
    named = lambda t, k: F.concat(F.lit(f"{t} "), k).alias("part")
    shown = F.concat_ws("/", F.coalesce("brand", F.lit("-")), F.coalesce(F.col("p_size").cast("string"), F.lit("-")), F.col("highly_variable").cast("string"))
    out = c.matrix.select(named("matrix", "layer"), F.col("obs_idx").alias("i"), F.col("var_idx").alias("j"), text("value"))
    out = out.unionByName(c.var.select(F.lit("var").alias("part"), F.col("var_idx").alias("i"), none, shown.alias("value")))
    out = out.unionByName(c.obs.select(F.lit("obs").alias("part"), F.col("obs_idx").alias("i"), none, F.concat_ws("/", "obs_id", "grp").alias("value")))
    out = out.unionByName(c.varm.select(named("varm", "key"), F.col("var_idx").alias("i"), F.posexplode("vec").alias("j", "v")).select("part", "i", F.col("j").cast("long").alias("j"), text("v")))
    for t in ("varp", "obsp"):
        out = out.unionByName(c.tables[t].filter("w <> 0").select(named(t, "key"), "i", "j", text("w")))
    leaves = c.uns.select(named("uns", "path"), F.posexplode(F.from_json("value", "array<long>")).alias("j", "v"))
    return out.unionByName(leaves.select("part", F.lit(0).cast("long").alias("i"), F.col("j").cast("long").alias("j"), text("v")))


def _whole(spark, d, name):
    path = scratch(spark, name)
    formats.save(_rich(spark, d), path)
    return _parts(formats.load(spark, path, check=False))


@query(_PARTS)
def q_h5ad_full(spark, d):
    return _whole(spark, d, ".h5ad")


@query(_PARTS)
def q_zarr_full(spark, d):
    return _whole(spark, d, ".zarr")


@query(_PARTS)
def q_h5seurat_full(spark, d):
    return _whole(spark, d, ".h5seurat")


@query(_PARTS)
def q_loom_roundtrip(spark, d):
    return _whole(spark, d, ".loom")


@query("select 'nations/' || n_name as path, '[' || n_nationkey || ', ' || n_regionkey || ']' as value from nation union all select 'props/' || (event_id // 16)::varchar || '/' || (event_id % 16)::varchar, '\"' || event_type || '\"' from events", base=False)
def q_uns_roundtrip(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("nations/"), "n_name").alias("path"), F.format_string("[%d, %d]", "n_nationkey", "n_regionkey").alias("value"))
    props = table(spark, d, "events").select(F.format_string("props/%d/%d", F.floor(F.col("event_id") / 16), F.col("event_id") % 16).alias("path"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value"))
    c = Container.of(spark, (1, 1), obs=spark.createDataFrame([(0, "c")], "obs_idx long, obs_id string"), var=spark.createDataFrame([(0, "g")], "var_idx long, var_id string"), uns=nations.unionByName(props))
    path = scratch(spark, ".h5ad")
    formats.save(c, path)
    return formats.load(spark, path).uns


_RAW_NAMES = "n as (select var_idx, var_id, row_number() over (partition by var_id order by var_idx) - 1 as k from var), u as (select var_idx, case when k = 0 then var_id else var_id || '.' || k end as var_id, var_id as stored from n)"


@query(f""", {_RAW_NAMES}, f as (select var_id, min(var_idx) as var_idx from var group by 1), r as (select replace(var_id, ' ', '_') as name, obs_idx, value from coo join f using (var_idx) where var_idx % 3 <> 0)
select 'counts' as layer, obs_idx, f.var_id as stored, u.var_id as name, value::double as value from r join f on replace(f.var_id, ' ', '_') = r.name join u on u.var_idx = f.var_idx
union all select 'X', obs_idx, u.stored, u.var_id, round(ln(1 + value), 6) from coo join u using (var_idx)""")
def q_counts_from_raw(spark, d):
    """X is normalised, names repeat, and raw/X holds counts of some features: the first of each name, of two thirds."""
    c = from_tables(spark, d)
    first = c.var.groupBy("var_id").agg(F.min("var_idx").alias("var_idx")).filter("var_idx % 3 <> 0")
    var = positions(first, "var_idx", out="new").select(F.col("new").alias("var_idx"), F.translate("var_id", " ", "_").alias("var_id"), F.col("var_idx").alias("old"))
    matrix = c.matrix.join(var.select(F.col("var_idx").alias("new"), F.col("old").alias("var_idx")), "var_idx").select("layer", "obs_idx", F.col("new").alias("var_idx"), "value")
    raw = Container.of(spark, (c.shape[0], var.count()), var=var.drop("old"), matrix=matrix)
    named = Container(spark, c.tables | {"var": c.var.withColumn("var_id", F.translate("var_id", " ", "_")), "matrix": c.matrix.withColumn("value", F.round(F.log1p("value"), 6))}, c.shape, c.attrs)
    path = scratch(spark, ".h5ad")
    formats.save(named, path, raw=raw)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the names repeat by design
        got = formats.load(spark, path)
    back = lambda x: F.translate(x, "_", " ")
    names = got.var.select("var_idx", back("var_id").alias("name"), back("orig_var_index").alias("stored"))
    return got.matrix.join(names, "var_idx").select("layer", "obs_idx", "stored", "name", "value")


@query(", s as (select obs_idx, var_idx, value from coo where var_idx % 2 = 0) select 'layers/counts' as place, obs_idx, var_idx, value::double as value from s union all select 'X', obs_idx, var_idx, value::double from coo")
def q_counts_stamp(spark, d):
    """A stamp goes before what the layout suggests, if what it names is there."""
    c = from_tables(spark, d)
    counts = c.matrix.filter("var_idx % 2 = 0").withColumn("layer", F.lit("counts"))
    out = None
    for stamp in ("layers/counts", "X"):
        uns = spark.createDataFrame([("writer/counts_location", f'"{stamp}"')], "path string, value string")
        path = scratch(spark, ".zarr")
        formats.save(Container(spark, c.tables | {"matrix": c.matrix.unionByName(counts), "uns": uns}, c.shape, c.attrs), path)
        got = formats.load(spark, path, check=False)
        own = got.counts().select(F.lit(got.attrs["counts_from"]).alias("place"), "obs_idx", "var_idx", "value")
        out = own if out is None else out.unionByName(own)
    return out


def _tissue(spark, d):
    """Suppliers as cells with polygons, events as molecules and pixels, in a library a nation key modulo 3."""
    c = from_tables(spark, d)
    cells = c.obs.select((F.col("obs_idx") % 3).alias("lib"), F.col("obs_idx").alias("cell_idx"), F.col("obs_id").alias("cell"))
    rank = positions(cells, "cell_idx", ("lib",), "at").withColumn("cell_idx", F.col("at"))
    v = rank.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    boundaries = v.select(F.format_string("lib%d", "lib").alias("library"), F.lit("cells").alias("boundary"), F.lit("Segmentation").alias("type"), "cell_idx", "cell", "vertex", (F.col("cell_idx") * 10.0 + F.col("vertex") / 4).alias("x"), (F.col("cell_idx") * 20.0 - F.col("vertex") / 4).alias("y"))
    e = table(spark, d, "events")
    molecules = e.select(F.lit("lib0").alias("library"), F.lit("molecules").alias("set"), F.col("event_id").alias("pos"), F.col("value").alias("x"), (F.col("user_id") * 0.5).alias("y"), F.col("event_type").alias("gene"))
    images = e.select(F.format_string("lib%d", F.col("event_id") % 3).alias("library"), F.lit("hires").alias("image"), F.floor(F.col("event_id") / 3 / 60).alias("h"), (F.floor(F.col("event_id") / 3) % 60 / 3).cast("long").alias("w"), (F.floor(F.col("event_id") / 3) % 3).alias("c"), "value")
    factors = spark.createDataFrame([(f"lib{k}", n, k + x) for k in range(3) for n, x in (("tissue_hires_scalef", 0.5), ("spot_diameter_fullres", 8.25))], "library string, name string, value double")
    return Container(spark, c.tables | {"boundaries": boundaries, "molecules": molecules, "images": images, "scalefactors": factors}, c.shape, c.attrs)


@query(""", b as (select obs_idx % 3 as lib, row_number() over (partition by obs_idx % 3 order by obs_idx) - 1 as cell_idx, obs_id as cell from obs)
select 'lib' || lib as library, cell_idx, cell, v::bigint as vertex, cell_idx * 10.0::double + v / 4 as x, cell_idx * 20.0::double - v / 4 as y from b, range(0, 4) r(v)""")
def q_fov_roundtrip(spark, d):
    path = scratch(spark, ".h5ad")
    formats.save(_tissue(spark, d), path)
    return formats.load(spark, path, check=False).tables["boundaries"].filter("boundary = 'cells' and type = 'Segmentation'").drop("boundary", "type")


@query("select event_id as pos, value as x, user_id * 0.5::double as y, event_type as gene from events", base=False)
def q_molecules_roundtrip(spark, d):
    path = scratch(spark, ".zarr")
    formats.save(_tissue(spark, d), path)
    return formats.load(spark, path, check=False).tables["molecules"].select("pos", "x", "y", "gene")


@query(""", i as (select 'lib' || event_id % 3 as library, event_id // 3 // 60 as h, event_id // 3 % 60 // 3 as w, event_id // 3 % 3 as c, value from events), g as (select library, h, w, c from (select library, max(h) as top from i group by 1) m, range(0, 100000) r(h), range(0, 20) s(w), range(0, 3) t(c) where h <= top)
select library, h::bigint as h, w::bigint as w, c::bigint as c, coalesce(value, 0) as value from g left join i using (library, h, w, c) union all select library, null, null, null, value from (values ('lib0', 0.5), ('lib0', 8.25), ('lib1', 1.5), ('lib1', 9.25), ('lib2', 2.5), ('lib2', 10.25)) f(library, value)""")
def q_visium_roundtrip(spark, d):
    """Images (what has no pixel is 0) and scale factors."""
    path = scratch(spark, ".h5ad")
    formats.save(_tissue(spark, d), path)
    t = formats.load(spark, path, check=False).tables
    return t["images"].select("library", "h", "w", "c", "value").unionByName(t["scalefactors"].select("library", "value"), allowMissingColumns=True)


@query("select event_id // 300 as h, event_id % 300 as w, value from events where value <> 0", base=False)
def q_ome_roundtrip(spark, d):
    px = table(spark, d, "events").select(F.floor(F.col("event_id") / 300).alias("h"), (F.col("event_id") % 300).alias("w"), F.lit(0).cast("long").alias("c"), "value")
    path = scratch(spark, ".spatialdata.zarr")
    c = Container.of(spark, (1, 1), obs=spark.createDataFrame([(0, "c")], "obs_idx long, obs_id string"), var=spark.createDataFrame([(0, "g")], "var_idx long, var_id string"))
    formats.save(Container(spark, c.tables | {"images/tissue": px}, c.shape), path)
    return formats.load(spark, path, check=False).tables["images/tissue"].filter("value <> 0").select("h", "w", "value")
