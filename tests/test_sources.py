"""Round trips, single and double, and malformed input."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators.joins import DataError
from cellmill.sources import formats
from cellmill.sources import zarr_store as Z
from cellmill.sources.container import Container, from_memory
from cellmill.sources.hdf5 import Hdf5Error, Tree, Writer
from cellmill.sources.hdf5_formats import is_nested
from cellmill.operators.spatial import image_axes
from cellmill.sources.spatial import SCHEMAS as SPATIAL
from cellmill.sources.spatial import image_coordinates
from cellmill.sources.registry import FormatError, file_type, list_formats
from cellmill.sources.zarr import ReadWarning, component, read_embeddings, read_obs


#: Scalars, lists, matrices, nested and empty groups, frames, sparse matrices, mixed lists, null.
UNS = {
    "name": "é", "count": 7, "share": 0.5, "flag": True, "none": {"encoding": "null"}, "empty": {}, "words": ["a", "", "é"], "numbers": [1, 2, 3], "floats": [1.5, 2.0], "flags": [True, False],
    "matrix": [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], "mixed": [1, "a", None, [2]], "big": 2**70, "no": [], "pca/params/n": 3, "pca/params/solver": "arpack", "pca/variance": [0.5, 0.25],
    "frame": {"encoding": "dataframe", "index": ["r0", "r1"], "columns": {"x": [1, 2], "y": ["p", "q"], "z": {"encoding": "categorical", "categories": ["lo", "hi"], "codes": [1, 0], "ordered": False}}},
    "sparse": {"encoding": "csr_matrix", "data": [1.0, 2.0], "indices": [0, 1], "indptr": [0, 1, 2], "shape": [2, 2]},
}


@pytest.fixture(scope="module")
def box(spark):
    """Unused levels, nulls, an empty row, an ordered factor."""
    obs = spark.createDataFrame([(0, "c0", 1.5, "A", True, 7), (1, "c1", None, "C", None, 8), (2, "c2", -2.0, None, False, 9), (3, "é", 0.0, "A", True, -1)], "obs_idx long, obs_id string, num double, fct string, flag boolean, n long")
    var = spark.createDataFrame([(0, "g0", "x", 1, True, "lo"), (1, "g1", "", None, False, "hi"), (2, "g2", None, 3, True, "lo")], "var_idx long, var_id string, tag string, rank long, hv boolean, level string")
    matrix = spark.createDataFrame([("X", 0, 2, 3.0), ("X", 0, 0, 1.0), ("X", 3, 1, 2.5), ("counts", 1, 1, 4.0)], "layer string, obs_idx long, var_idx long, value double")
    levels = spark.createDataFrame([("obs", "fct", k, x, True) for k, x in enumerate(["C", "A", "D_unused"])] + [("var", "level", k, x, False) for k, x in enumerate(["lo", "hi"])], "tbl string, col string, code long, label string, ordered boolean")
    obsm = spark.createDataFrame([("X_pca", k, [float(k), 1.0]) for k in range(4)], "key string, obs_idx long, vec array<double>")
    obsp = spark.createDataFrame([("distances", 0, 3, 0.5), ("distances", 3, 0, 0.25)], "key string, i long, j long, w double")
    varm = spark.createDataFrame([("PCs", k, [0.5 * k, float(-k)]) for k in range(3)] + [("other", k, [1.0]) for k in range(3)], "key string, var_idx long, vec array<double>")
    varp = spark.createDataFrame([("corr", 0, 1, 0.5), ("corr", 2, 2, 1.0)], "key string, i long, j long, w double")
    uns = spark.createDataFrame([(k, json.dumps(v)) for k, v in UNS.items()], "path string, value string")
    return Container.of(spark, (4, 3), obs=obs, var=var, matrix=matrix, levels=levels, obsm=obsm, obsp=obsp, varm=varm, varp=varp, uns=uns)


def rows(df):
    return sorted((tuple(r.asDict(True).items()) for r in df.collect()), key=str)


def same(a, b, tables=("obs", "var", "matrix", "obsm", "varm", "obsp", "varp", "levels")):
    assert a.shape == tuple(b.shape)
    for t in tables:
        x, y = a.tables[t], b.tables[t]
        assert x.dtypes == y.dtypes and rows(x) == rows(y.select(x.columns)), t
    values = lambda c: {r.path: json.loads(r.value) for r in c.uns.collect()}
    assert values(a) == values(b)


@pytest.mark.parametrize("ext", ["parquet", "zarr", "h5ad", "h5seurat", "loom"])
def test_double_round_trip(spark, box, tmp_path, ext):
    one, two = f"{tmp_path}/one.{ext}", f"{tmp_path}/two.{ext}"
    formats.save(box, one)
    same(box, formats.load(spark, one))
    formats.convert(spark, one, two)
    same(box, formats.load(spark, two))
    with pytest.raises(DataError):
        formats.save(box, one)
    formats.save(box, one, overwrite=True)
    part = formats.load(spark, one, components=["obs"])
    assert part.obsm.count() == 0 and part.matrix.count() == 3
    whole = part.load_more(one, ["obsm", "uns", "layers"])
    assert rows(whole.obsm) == rows(box.obsm) and whole.uns.count() == len(UNS) and rows(whole.matrix) == rows(box.matrix)


def test_zarr_v3_and_zstd(spark, box, tmp_path):
    formats.save(box, f"{tmp_path}/v3.zarr", version=3, codec="zstd")
    same(box, formats.load(spark, f"{tmp_path}/v3.zarr"))


def test_hop_through_all(spark, box, tmp_path):
    steps = [f"{tmp_path}/a.zarr", f"{tmp_path}/b.h5ad", f"{tmp_path}/c.parquet", f"{tmp_path}/d.zarr"]
    formats.save(box, steps[0])
    for a, b in zip(steps, steps[1:], strict=False):
        formats.convert(spark, a, b)
    same(box, formats.load(spark, steps[-1]))


def test_loom_layout(spark, box, tmp_path):
    formats.save(box, f"{tmp_path}/a.loom")
    t = Tree(f"{tmp_path}/a.loom")
    assert t.array("matrix").read().tolist() == [[1, 0, 0, 0], [0, 0, 0, 2.5], [3, 0, 0, 0]] and t.array("layers/counts").shape == [3, 4]
    assert t.array("col_attrs/X_pca").shape == [4, 2] and t.array("col_graphs/distances/a").read().tolist() == [0, 3]
    valid = Container(spark, box.tables | {"obs": box.obs.withColumn("Valid", (F.col("obs_idx") != 1).cast("long"))}, box.shape)
    formats.save(valid, f"{tmp_path}/v.loom")
    got = formats.load(spark, f"{tmp_path}/v.loom", valid_only=True)
    assert got.shape == (3, 3) and [r.obs_id for r in got.obs.orderBy("obs_idx").collect()] == ["c0", "c2", "é"]
    assert sorted((r.obs_idx, r.vec[0]) for r in got.obsm.collect()) == [(0, 0.0), (1, 2.0), (2, 3.0)] and sorted((r.i, r.j) for r in got.obsp.collect()) == [(0, 2), (2, 0)]


def test_gzip_level(spark, box, tmp_path):
    big = box.matrix.filter("layer = 'X'").unionByName(spark.range(4 * 3).select(F.lit("ones").alias("layer"), F.floor(F.col("id") / 3).alias("obs_idx"), (F.col("id") % 3).alias("var_idx"), F.lit(1.0).alias("value")))
    c = Container(spark, box.tables | {"matrix": big}, box.shape)
    for ext in ("h5ad", "h5seurat", "loom", "zarr", "parquet"):
        for level in (0, 6):
            formats.save(c, f"{tmp_path}/l{level}.{ext}", level=level)
            same(c, formats.load(spark, f"{tmp_path}/l{level}.{ext}"))
    from cellmill.sources.hdf5 import Tree as T

    assert T(f"{tmp_path}/l6.h5ad").array("X/data").filters == [1] and not T(f"{tmp_path}/l0.h5ad").array("X/data").filters
    with pytest.raises(FormatError):
        formats.save(c, f"{tmp_path}/x.h5ad", colour="red")


def test_slices_are_pushed_down(spark, tmp_path):
    n = 40
    x = spark.range(n).select(F.lit("X").alias("layer"), F.col("id").alias("obs_idx"), (F.col("id") % 3).alias("var_idx"), F.lit(1.0).alias("value"))
    c = Container.of(spark, (n, 3), obs=spark.range(n).select(F.col("id").alias("obs_idx"), F.concat(F.lit("c"), "id").alias("obs_id")), var=spark.createDataFrame([(k, f"g{k}") for k in range(3)], "var_idx long, var_id string"), matrix=x)
    formats.save(c, f"{tmp_path}/s.zarr")
    df = component(spark, f"{tmp_path}/s.zarr", "X", rows=4)
    assert df.rdd.getNumPartitions() == 10
    assert df.filter("obs_idx in (3, 37)").rdd.getNumPartitions() == 2
    assert df.filter("obs_idx >= 12 and obs_idx < 18").rdd.getNumPartitions() == 2
    assert [r.obs_idx for r in df.filter("obs_idx >= 12 and obs_idx < 18").orderBy("obs_idx").collect()] == list(range(12, 18))


def test_malformed(spark, tmp_path):
    os.makedirs(f"{tmp_path}/bad.zarr")
    with pytest.raises(DataError):
        formats.load(spark, f"{tmp_path}/bad.zarr")
    (tmp_path / "bad.h5ad").write_bytes(b"not hdf5" * 20)
    with pytest.raises(Hdf5Error):
        formats.load(spark, f"{tmp_path}/bad.h5ad")
    with pytest.raises(FormatError):
        formats.load(spark, f"{tmp_path}/x.unknown")
    store = Z.Store(f"{tmp_path}/codec.zarr")
    store.put("a/.zarray", json.dumps({"zarr_format": 2, "shape": [2], "chunks": [2], "dtype": "<f8", "compressor": {"id": "blosc"}, "fill_value": 7, "order": "C", "filters": None}).encode())
    assert Z.Array(store, "a").read().tolist() == [7, 7]  # a missing chunk holds the fill value
    store.put("a/0", b"xx")
    with pytest.raises(Z.ZarrError):
        Z.Array(store, "a").read()


def test_hdf5_layer(tmp_path):
    path = f"{tmp_path}/a.h5"
    with Writer(path) as w:
        w.group("g", {"text": "é", "numbers": [1, 2], "flag": True, "names": ["a", "b"], "none": []})
        w.dataset("g/x", [np.arange(6).reshape(2, 3), np.arange(6, 9).reshape(1, 3)], [3, 3], "<i4")
        w.dataset("g/s", [np.array([f"é{k}" for k in range(9000)], dtype=object)], [9000], "string")
        for k in range(50):
            w.dataset(f"many/d{k:02d}", [np.array([k / 2])], [1], "<f4")
    t = Tree(path)
    assert t.attrs("g") == {"text": "é", "numbers": [1, 2], "flag": True, "names": ["a", "b"], "none": []}
    assert t.array("g/x").read(1, 3).tolist() == [[3, 4, 5], [6, 7, 8]] and t.array("g/s").read(8998).tolist() == ["é8998", "é8999"]
    assert len(t.children("many")) == 50 and t.array("many/d49").read().tolist() == [24.5] and t.kind("nope") is None
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]


def test_file_types(tmp_path):
    assert [file_type(x) for x in ("a.H5AD", "soma://u/x", "a.cellbin.gef", "b.spatialdata.zarr/", "c.zarr")] == ["h5ad", "soma", "cellbin.gef", "spatialdata.zarr", "zarr"]
    for n in ("s_exprMat_file.csv", "s_metadata_file.csv"):
        (tmp_path / n).write_text("")
    assert file_type(str(tmp_path)) == "cosmx"
    assert list_formats()["h5ad"] == (True, True) and list_formats()["cosmx"] == (True, False)


def test_h5seurat_h5mu_query_spatialdata(spark, box, tmp_path):
    formats.save(box, f"{tmp_path}/a.h5seurat")
    got = formats.load(spark, f"{tmp_path}/a.h5seurat")
    assert rows(got.matrix) == rows(box.matrix) and rows(got.obs.select("obs_id", "fct", "flag")) == rows(box.obs.select("obs_id", "fct", "flag"))
    assert rows(got.levels.select("code", "label")) == rows(box.levels.select("code", "label")) and rows(got.obsm) == rows(box.obsm)
    formats.save({"rna": box, "prot": box}, f"{tmp_path}/a.h5mu")
    both = formats.load(spark, f"{tmp_path}/a.h5mu")
    assert list(both) == ["rna", "prot"]
    same(box, both["prot"])
    t = Tree(f"{tmp_path}/a.h5mu")
    assert t.array("varmap/prot").read().tolist() == [-1, -1, -1, 0, 1, 2] and t.array("var/_index").read().tolist()[0] == "rna:g0"
    with pytest.raises(FormatError):
        formats.load(spark, f"soma://{tmp_path}/s")
    formats.save(box, f"{tmp_path}/s.parquet")
    part = formats.load(spark, f"{tmp_path}/s.parquet", obs_query="n < 8 and num is not null")
    assert sorted(r.obs_idx for r in part.obs.collect()) == [0, 3] and {r.obs_idx for r in part.matrix.collect()} == {0, 3} and part.obsp.count() == 2
    box.tables["points/genes"] = spark.createDataFrame([(1.0, 2.0, "g")], "x double, y double, gene string")
    formats.save(box, f"{tmp_path}/a.spatialdata.zarr")
    got = formats.load(spark, f"{tmp_path}/a.spatialdata.zarr")
    same(box, got)
    assert rows(got.tables["points/genes"]) == rows(box.tables.pop("points/genes"))


def test_h5seurat_nested_layers(spark, box, tmp_path):
    formats.save(box, f"{tmp_path}/old.h5seurat")
    formats.convert(spark, f"{tmp_path}/old.h5seurat", f"{tmp_path}/new.h5seurat", nested=True)
    assert [is_nested(f"{tmp_path}/{n}.h5seurat") for n in ("old", "new")] == [False, True]
    same(box, formats.load(spark, f"{tmp_path}/new.h5seurat"))
    formats.convert(spark, f"{tmp_path}/new.h5seurat", f"{tmp_path}/adt.h5seurat", assay=None, nested=True)
    formats.save({"rna": box, "prot": box}, f"{tmp_path}/two.h5mu")
    formats.convert(spark, f"{tmp_path}/two.h5mu", f"{tmp_path}/one.h5ad", assay="ADT")
    same(box, formats.load(spark, f"{tmp_path}/one.h5ad"))


def test_gef(spark, tmp_path):
    from cellmill.sources.vendor import cell_bins, square_bins

    genes = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 4, 1), (3, 5, 3), (4, 8, 0)], "gene long, offset long, count long")
    expression = spark.createDataFrame([(k, x, y, n) for k, (x, y, n) in enumerate([(10, 5, 3), (20, 15, 2), (10, 5, 1), (30, 25, 4), (20, 15, 5), (10, 5, 1), (20, 15, 1), (10, 5, 1)])], "pos long, x long, y long, n long")
    spots, sums = square_bins(genes, expression)
    assert [r.spot_id for r in spots.orderBy("spot").collect()] == ["spot_10_5", "spot_20_15", "spot_30_25"]
    assert {(r.spot, r.gene): r.value for r in sums.collect()} == {(0, 0): 3, (1, 0): 2, (0, 1): 1, (2, 1): 4, (1, 2): 5, (0, 3): 2, (1, 3): 1}
    with pytest.raises(DataError):
        square_bins(genes.filter("gene < 2"), expression)
    cells = cell_bins(spark.createDataFrame([("a", 0, 2), ("b", 2, 6)], "cell string, offset long, gene_count long"), expression.withColumn("gene", F.col("pos") % 2))
    assert {(r.cell, r.gene): r.value for r in cells.collect()} == {("a", 0): 3, ("a", 1): 2, ("b", 0): 7, ("b", 1): 6}


def test_cosmx(spark, tmp_path):
    (tmp_path / "s_exprMat_file.csv").write_text("fov,cell_ID,GeneA,GeneB\n1,1,2,0\n1,2,0,3\n2,1,1,1\n2,9,5,5\n")
    (tmp_path / "s_metadata_file.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px,Mean.DAPI\n1,1,10,20,1.5\n1,2,11,21,2\n2,1,12,22,3\n")
    c = formats.load(spark, str(tmp_path))
    assert [r.obs_id for r in c.obs.orderBy("obs_idx").collect()] == ["1_1", "1_2", "2_1"] and c.shape == (3, 2)
    assert {(r.obs_idx, r.var_idx): r.value for r in c.matrix.collect()} == {(0, 0): 2, (1, 0): 1, (1, 1): 1, (2, 1): 3}
    (tmp_path / "s_tx_file.csv").write_text("fov,cell_ID,x_global_px,y_global_px,target\n1,1,1,2,GeneA\n1,2,3,4,GeneB\n")
    (tmp_path / "s-polygons.csv").write_text("fov,cellID,x_global_px,y_global_px\n" + "".join(f"1,{c},{c + v},{v}\n" for c in (2, 1) for v in range(3)))
    c = formats.load(spark, str(tmp_path))
    assert [r.obs_id for r in c.obs.orderBy("obs_idx").collect()] == ["1_1", "2_1"]
    formats.save(c, f"{tmp_path}/a.h5ad")
    t = formats.load(spark, f"{tmp_path}/a.h5ad").tables
    assert sorted((r.cell, r.vertex, r.x, r.y) for r in t["boundaries"].filter("type = 'Segmentation'").collect()) == [(f"{c}_1", v, c + v, v) for c in (1, 2) for v in range(3)]
    assert sorted((r.gene, r.x) for r in t["molecules"].collect()) == [("GeneA", 1), ("GeneB", 3)] and t["boundaries"].filter("type = 'Centroids'").count() == 2


def test_xenium(spark, tmp_path):
    bundle = f"{tmp_path}/x"
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{bundle}/{name}.parquet")
    put("cells", [("b", 1.0, 2.0), ("a", 3.0, 4.0)], "cell_id string, x_centroid double, y_centroid double")
    put("transcripts", [("a", "G1", 1.0, 1.0, 30.0), ("a", "G1", 1.0, 2.0, 40.0), ("a", "G2", 1.0, 2.0, 5.0), ("b", "G2", 0.0, 0.0, 20.0), ("UNASSIGNED", "G1", 0.0, 0.0, 40.0)], "cell_id string, feature_name string, x_location double, y_location double, qv double")
    put("cell_boundaries", [("a", float(v), 0.0) for v in range(3)], "cell_id string, vertex_x double, vertex_y double")
    c = formats.load(spark, bundle)
    assert [r.obs_id for r in c.obs.orderBy("obs_idx").collect()] == ["a", "b"] and {(r.obs_idx, r.var_idx): r.value for r in c.matrix.collect()} == {(0, 0): 2, (1, 1): 1}
    assert c.tables["molecules"].count() == 5 and c.tables["boundaries"].filter("type = 'Segmentation' and cell_idx = 0").count() == 3
    with Writer(f"{tmp_path}/x/cell_feature_matrix.h5") as w:
        w.dataset("matrix/barcodes", [["b", "a"]], [2], "string")
        w.dataset("matrix/features/name", [["G1", "G2", "G3"]], [3], "string")
        for k, v in (("indptr", [0, 1, 3]), ("indices", [2, 0, 1]), ("data", [7, 1, 4])):
            w.dataset(f"matrix/{k}", [np.array(v)], [len(v)], "<i4")
    c = formats.load(spark, bundle)
    assert c.shape == (2, 3) and {(r.obs_idx, r.var_idx): r.value for r in c.matrix.collect()} == {(1, 2): 7, (0, 0): 1, (0, 1): 4}


def test_h5mu_modalities_are_not_dropped(spark, box, tmp_path):
    formats.save({"rna": box, "prot": box}, f"{tmp_path}/two.h5mu")
    with pytest.raises(formats.FormatError, match="rna, prot"):
        formats.convert(spark, f"{tmp_path}/two.h5mu", f"{tmp_path}/two.h5ad")
    formats.save({"rna": box}, f"{tmp_path}/one.h5mu")
    formats.convert(spark, f"{tmp_path}/one.h5mu", f"{tmp_path}/one.h5ad")
    assert formats.load(spark, f"{tmp_path}/one.h5ad").shape == box.shape


@pytest.fixture(scope="module")
def tissue(spark, box):
    """Two libraries: images, scale factors, polygons, centroids, molecules."""
    px = [(lib, image, h, w, c, (h * 10 + w + c / 10) / 100) for lib, image, hh, ww in (("b", "hires", 5, 4), ("a", "lowres", 2, 3)) for h in range(hh) for w in range(ww) for c in range(3)]
    polygons = [("a", "cells", "Segmentation", k, f"c{k}", v, 10.0 * k + (v in (1, 2)) * 2, 20.0 * k + (v in (2, 3)) * 2) for k in range(6) for v in range(4 if k != 2 else 3)]
    points = [("a", "middles", "Centroids", k, f"c{k}", 0, 10.0 * k + 1, 20.0 * k + 1) for k in range(6)]
    tables = {
        "images": spark.createDataFrame(px, SPATIAL["images"]), "scalefactors": spark.createDataFrame([("a", "tissue_hires_scalef", 0.5), ("a", "spot_diameter_fullres", 89.0), ("b", "tissue_lowres_scalef", 0.25)], SPATIAL["scalefactors"]),
        "boundaries": spark.createDataFrame(polygons + points, SPATIAL["boundaries"]), "molecules": spark.createDataFrame([("a", "molecules", k, k / 2, -1.0 * k, f"G{k % 2}") for k in range(5)], SPATIAL["molecules"]),
    }
    return Container(spark, box.tables | tables, box.shape)


@pytest.mark.parametrize("ext", ["h5ad", "zarr", "h5seurat", "loom", "parquet"])
def test_spatial_round_trip(spark, tissue, tmp_path, ext):
    formats.save(tissue, f"{tmp_path}/one.{ext}")
    formats.convert(spark, f"{tmp_path}/one.{ext}", f"{tmp_path}/two.{ext}")
    got = formats.load(spark, f"{tmp_path}/two.{ext}")
    same(tissue, got)
    for t in SPATIAL:
        assert rows(got.tables[t]) == rows(tissue.tables[t]), t


def test_image_coordinates(spark, tissue):
    spots = tissue.obsm.filter("key = 'X_pca'")
    at = {r.obs_idx: (r.x, r.y) for r in image_coordinates(spots, tissue.tables["scalefactors"], "a").collect()}
    assert at == {k: (k / 2, 0.5) for k in range(4)}
    assert {r.x for r in image_coordinates(spots, tissue.tables["scalefactors"], "b").collect()} == {0, 0.25, 0.5, 0.75}


def test_spatialdata_images(spark, box, tmp_path):
    px = spark.range(300 * 270 * 2).select((F.col("id") % 300).alias("h"), (F.floor(F.col("id") / 300) % 270).alias("w"), F.floor(F.col("id") / 81000).alias("c"), (F.col("id") % 1009 + 1.0).alias("value"))
    masks = px.filter("c = 0").withColumn("value", F.floor(F.col("value") / 100) + 1.0)
    c = Container(spark, box.tables | {"images/tissue": px, "labels/cells": masks}, box.shape)
    formats.save(c, f"{tmp_path}/a.spatialdata.zarr")
    got = formats.load(spark, f"{tmp_path}/a.spatialdata.zarr")
    for t in ("images/tissue", "labels/cells"):
        assert got.tables[t].exceptAll(c.tables[t]).isEmpty() and got.tables[t].count() == c.tables[t].count()
    store = Z.Store(f"{tmp_path}/a.spatialdata.zarr")
    assert store.array("images/tissue/0").shape == [2, 300, 270] and store.array("images/tissue/0").chunks == [2, 256, 256] and got.attrs["images"] == ["tissue"]


def test_image_axes():
    assert image_axes([7, 9]) == {"h": 0, "w": 1} and image_axes([3, 7, 9]) == {"c": 0, "h": 1, "w": 2} and image_axes([7, 9, 4]) == {"h": 0, "w": 1, "c": 2}
    assert image_axes([7, 9, 5]) == {"c": 0, "h": 1, "w": 2} and image_axes([2, 3, 7, 9]) == {"c": 1, "h": 2, "w": 3} and image_axes([2, 3, 1, 7, 9]) == {"c": 1, "h": 3, "w": 4}
    assert image_axes([9, 3, 7], ["x", "c", "y"]) == {"h": 2, "w": 0, "c": 1}


@pytest.fixture
def web(tmp_path):
    """A server of tmp_path that also lists it, two names a page, as a bucket's service does."""
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(SimpleHTTPRequestHandler):
        asked = []

        def do_GET(self):
            self.asked.append(self.path)
            query = parse_qs(urlparse(self.path).query)
            if "list-type" not in query:
                return super().do_GET()
            prefix, after = query["prefix"][0], int(query.get("continuation-token", ["0"])[0])
            folder = tmp_path / prefix
            names = sorted(p.name for p in folder.iterdir() if p.is_dir()) if folder.is_dir() else []
            page = "".join(f"<CommonPrefixes><Prefix>{prefix}{n}/</Prefix></CommonPrefixes>" for n in names[after : after + 2])
            more = f"<NextContinuationToken>{after + 2}</NextContinuationToken>" if after + 2 < len(names) else ""
            raw = f'<ListBucketResult xmlns="x">{page}{more}</ListBucketResult>'.encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler.asked
    server.shutdown()


def test_web_store(spark, box, web, tmp_path):
    address, asked = web
    formats.save(box, f"{tmp_path}/data/a.zarr")
    got = formats.load(spark, "s3://bucket/data/a.zarr", endpoint=address)
    same(box, got)
    cached = formats.load(spark, "s3://bucket/data/a.zarr", endpoint=address, cache=f"{tmp_path}/cache", check=False)
    assert rows(cached.obs) == rows(box.obs)
    asked.clear()
    assert rows(cached.obs) == rows(box.obs) and not [a for a in asked if a.endswith("codes/0")]
    base = tmp_path / "data/a.zarr"
    names = {str(p.relative_to(base)): json.loads(p.read_text()) for p in base.rglob(".z*")}
    (base / ".zmetadata").write_text(json.dumps({"metadata": names, "zarr_consolidated_format": 1}))
    same(box, formats.load(spark, f"{address}/data/a.zarr"))
    with pytest.raises(Z.ZarrError):
        Z.open_store(address).put("x", b"")


def test_from_memory(spark):
    import pandas as pd

    counts = np.array([[1, 0, 3], [0, 2, 0]])
    c = from_memory(spark, {"counts": counts, "logcounts": np.log1p(counts)}, pd.DataFrame({"kind": ["a", "b", "c"]}, index=["x", "y", "z"]), None, {"X_pca": np.eye(3)})
    assert c.shape == (3, 2) and [r.obs_id for r in c.obs.orderBy("obs_idx").collect()] == ["x", "y", "z"] and [r.var_id for r in c.var.orderBy("var_idx").collect()] == ["Gene1", "Gene2"]
    assert {(r.obs_idx, r.var_idx): r.value for r in c.counts().collect()} == {(0, 0): 1, (2, 0): 3, (1, 1): 2} and c.layers() == ["X", "counts"] and c.obsm.count() == 3
    assert from_memory(spark, {"counts": counts}).layers() == ["X"] and from_memory(spark, {"counts": counts}).attrs["x_holds"] == "counts"
    with pytest.raises(DataError):
        from_memory(spark, {"counts": counts, "other": counts.T})


def test_ambiguous_sparse_and_old_layouts(spark, tmp_path):
    """No shape, no encoding, parts called i, p, x, columns by length; codes beside __categories; X the other way round."""
    def file(name, fill):
        with Writer(f"{tmp_path}/{name}.h5ad") as w:
            for axis, n in (("obs", 3), ("var", 2)):
                w.group(axis, {"_index": "index"})
                w.dataset(f"{axis}/index", [[f"{axis}{k}" for k in range(n)]], [n], "string")
            fill(w)
        return formats.load(spark, f"{tmp_path}/{name}.h5ad")

    entries = lambda c: sorted((r.obs_idx, r.var_idx, r.value) for r in c.matrix.collect())
    put = lambda w, key, values, dtype="<f8": w.dataset(key, [np.array(values)], list(np.shape(values)), dtype)

    def by_columns(w):
        put(w, "X/x", [1.0, 2.0, 3.0])
        put(w, "X/i", [0, 2, 1], "<i4")
        put(w, "X/p", [0, 2, 3], "<i4")
        w.group("obs/__categories")
        w.dataset("obs/__categories/kind", [["lo", "hi"]], [2], "string")
        put(w, "obs/kind", [1, -1, 0], "|i1")

    c = file("columns", by_columns)
    assert entries(c) == [(0, 0, 1), (1, 1, 3), (2, 0, 2)] and [r.kind for r in c.obs.orderBy("obs_idx").collect()] == ["hi", None, "lo"]
    assert entries(file("turned", lambda w: put(w, "X", [[1.0, 0, 2], [0, 3, 0]]))) == [(0, 0, 1), (1, 1, 3), (2, 0, 2)]
    with pytest.raises(DataError):
        file("wrong", lambda w: put(w, "X", [[1.0, 0], [0, 3]]))

    def raw_only(w):
        put(w, "raw/X", [[1.0, 0], [0, 3], [2, 0]])

    assert entries(file("raw", raw_only)) == [(0, 0, 1), (1, 1, 3), (2, 0, 2)]

    def odd_parts(w):
        put(w, "X", [[1.5, 0], [0, 3], [2, 0]])
        put(w, "obsm/X_ok", [[1.0], [2], [3]])
        put(w, "obsm/X_short", [[1.0], [2]])

    with pytest.warns(ReadWarning):
        c = file("odd", odd_parts)
    assert c.keys("obsm") == ["X_ok"]

    def bad_layer(w):
        put(w, "X", [[1.0, 0], [0, 3], [2, 0]])
        put(w, "layers/l", [[1.0, 0]])

    with pytest.raises(DataError):
        file("layer", bad_layer)


def test_selection(spark, box, tmp_path):
    formats.save(box, f"{tmp_path}/a.h5ad")
    none = formats.load(spark, f"{tmp_path}/a.h5ad", include_x=False, layers=[])
    assert none.matrix.count() == 0 and none.shape == (4, 3)
    some = formats.load(spark, f"{tmp_path}/a.h5ad", layers=["counts"], obsm=["X_pca"], obsp=[])
    assert some.obsp.count() == 0 and some.layers() == ["X", "counts"] and some.reductions() == {"pca": "X_pca"}
    with pytest.warns(ReadWarning):
        formats.load(spark, f"{tmp_path}/a.h5ad", obsm=["gone"])
    assert [r.obs_id for r in read_obs(spark, f"{tmp_path}/a.h5ad").orderBy("obs_idx").collect()] == ["c0", "c1", "c2", "é"]
    assert read_embeddings(spark, f"{tmp_path}/a.h5ad").count() == 4
    with pytest.raises(DataError):
        box.append(some.query("obs_idx < 2"))
    more = Container(spark, box.tables | {"obsm": box.obsm.limit(0), "matrix": box.matrix.filter("layer = 'X'")}, box.shape)
    assert rows(more.append(box).obsm) == rows(box.obsm) and rows(more.append(box).matrix) == rows(box.matrix)


def test_cell_bins_file(spark, monkeypatch):
    """A file of cell bins as records; the HDF5 writer has no records, so the tree is made up."""
    import cellmill.sources.hdf5_formats as h

    class Rows:  # classes in here travel to the workers by value
        def __init__(self, values):
            self.values, self.shape, self.dtype = values, list(values.shape), values.dtype

        def read(self, begin=0, end=None):
            return self.values[begin:end]

    class Records:
        def __init__(self, nodes):
            self.nodes = nodes

        def kind(self, key):
            return "array" if key in self.nodes else None

        def array(self, key):
            return Rows(self.nodes[key])

    cells = np.array([(0, 2, 5, 6), (2, 1, 7, 8)], dtype=[("offset", "<u4"), ("geneCount", "<u2"), ("x", "<i4"), ("y", "<i4")])
    genes = np.array([(b"A",), (b"B",)], dtype=[("geneName", "S32")])
    entries = np.array([(0, 3), (1, 1), (1, 9)], dtype=[("geneID", "<u4"), ("count", "<u2")])
    monkeypatch.setattr(h, "Tree", lambda path: Records({"cellBin/cell": cells, "cellBin/gene": genes, "cellBin/cellExp": entries}))
    c = h.read_cellbin_gef(spark, "x.cellbin.gef")
    assert {(r.obs_idx, r.var_idx): r.value for r in c.matrix.collect()} == {(0, 0): 3, (0, 1): 1, (1, 1): 9} and c.obs.orderBy("obs_idx").first().x == 5
    assert list_formats()["cellbin.gef"] == (True, False)


def test_uns_of_many_small_groups(spark, tmp_path):
    """A leaf takes some hundred bytes, whatever the number of groups beside it; tasks read a wide group."""
    rows = [(f"props/{k // 4}/{k % 4}", f'"t{k % 7}"') for k in range(5000)] + [("props-x", "[1, 2]"), ("zero", "{}"), ("long", '"' + "x" * 5000 + '"')]
    one = lambda axis, name: spark.createDataFrame([(0, name)], f"{axis}_idx long, {axis}_id string")
    c = Container.of(spark, (1, 1), obs=one("obs", "c"), var=one("var", "g"), uns=spark.createDataFrame(rows, "path string, value string"))
    path = f"{tmp_path}/many.h5ad"
    formats.save(c, path)
    assert os.path.getsize(path) < 5000 * 1000
    assert sorted(map(tuple, formats.load(spark, path).uns.collect())) == sorted(rows)


def test_loom_of_a_sparse_matrix(spark, tmp_path):
    """Tiles without entries take no room; those at the edges and values beside them come back."""
    n, p = 2999, 3001
    entries = [("X", 0, 0, 1.5), ("X", n - 1, p - 1, 2.0), ("X", 127, 128, 3.0), ("X", 128, 127, 4.0), ("X", n - 1, 0, 5.0), ("counts", 1000, 2000, 7.0)]
    axis = lambda name, size: spark.range(size).select(F.col("id").alias(f"{name}_idx"), F.format_string(f"{name}%d", "id").alias(f"{name}_id"))
    c = Container.of(spark, (n, p), obs=axis("obs", n), var=axis("var", p), matrix=spark.createDataFrame(entries, "layer string, obs_idx long, var_idx long, value double"))
    path = f"{tmp_path}/sparse.loom"
    formats.save(c, path)
    assert os.path.getsize(path) < 2_000_000
    assert sorted(map(tuple, formats.load(spark, path, check=False).matrix.select("layer", "obs_idx", "var_idx", "value").collect())) == sorted(entries)


def test_uns_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces that end anywhere give one tree; no group is listed again for each of its children."""
    values = ['"t"', "[1, 2]", "[1, \"a\", null]", "true", '["x", "yy"]', "{}", '{"encoding": "null"}', "2.5", '{"encoding": "categorical", "categories": ["a", "b"], "codes": [0, 1], "ordered": true}']
    rows = [(f"g{k // 40}/s-{k // 5 % 8}/{k % 5}", values[k % 9]) for k in range(400)] + [("g", "{}"), ("g-1", "1"), ("g/x", '"in g"'), ("g3", "{}"), ("wide/é", '"ü"')] + [(f"wide/{k}/v", str(k)) for k in range(1500)]
    axis = lambda name: spark.createDataFrame([(0, name)], f"{name}_idx long, {name}_id string")
    want = sorted((p, json.loads(v)) for p, v in rows if p not in ("g", "g3"))  # groups that have more in them
    for piece in (7, 20_000):
        monkeypatch.setattr("cellmill.sources.hdf5_formats.PIECE", piece)
        c = Container.of(spark, (1, 1), obs=axis("obs"), var=axis("var"), uns=spark.createDataFrame(rows, "path string, value string"))
        path = f"{tmp_path}/pieces{piece}.h5ad"
        formats.save(c, path)
        assert [(r.path, json.loads(r.value)) for r in formats.load(spark, path).uns.orderBy("path").collect()] == want
    tree, listed = Tree(path), []
    symbols = Tree._symbols
    monkeypatch.setattr(Tree, "_symbols", lambda self, *a: listed.append(a[0]) or symbols(self, *a))
    from cellmill.sources.uns import leaves

    assert sum(1 for _ in leaves(tree, "uns", "")) == len(want) and len(listed) == len({*listed})


def test_loom_reads_the_matrix_once(spark, tmp_path):
    """Layers are found with their tiles, which come in any order; loadings have gaps and rows of several lengths."""
    n, p = 700, 500
    random.seed(6)
    made = spark.sparkContext.accumulator(0)
    entries = sorted({(random.choice(("X", "counts")), random.randrange(n), random.randrange(p)) for _ in range(900)})

    def noted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    axis = lambda name, size: spark.range(size).select(F.col("id").alias(f"{name}_idx"), F.format_string(f"{name}%d", "id").alias(f"{name}_id"))
    rows = spark.createDataFrame([(*e, float(k + 1)) for k, e in enumerate(entries)], "layer string, obs_idx long, var_idx long, value double")
    vectors = {(key, k): [k * 1.0, k / 2][: 1 + k % 2] for key in ("A", "B") for k in range(3, p - 3) if k % 7}
    varm = spark.createDataFrame([(*at, v) for at, v in vectors.items()], "key string, var_idx long, vec array<double>")
    c = Container.of(spark, (n, p), obs=axis("obs", n), var=axis("var", p), matrix=rows.mapInArrow(noted, rows.schema), varm=varm)
    path = f"{tmp_path}/once.loom"
    formats.save(c, path)
    assert made.value == len(entries)
    got = formats.load(spark, path, check=False)
    assert sorted(map(tuple, got.matrix.select("layer", "obs_idx", "var_idx", "value").collect())) == sorted(map(tuple, rows.collect()))
    padded = {(key, k): [str(x) for x in (vectors.get((key, k), []) + [float("nan")] * 2)[:2]] for key in ("A", "B") for k in range(p)}
    assert {(r.key, r.var_idx): [str(x) for x in r.vec] for r in got.varm.collect()} == padded
