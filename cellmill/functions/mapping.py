"""Name maps between formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that files and hub use for one thing.
REDUCTION_KEYS = {"pca": "PC_", "tsne": "tSNE_", "umap": "UMAP_", "harmony": "harmony_", "scvi": "scVI_"}
LAYERS_IN = {"log_normalized": "data", "scaled": "scale.data"}
LAYERS_OUT = {"scale.data": "scaled"}
GRAPHS_IN = {"connectivities": "snn", "distances": "nn"}
MODALITY_TO_ASSAY = {"rna": "RNA", "prot": "ADT", "atac": "ATAC", "spatial": "Spatial", "hto": "HTO", "sct": "SCT"}
ASSAY_TO_MODALITY = {"RNA": "rna", "ADT": "prot", "ATAC": "atac", "Spatial": "spatial", "HTO": "hto", "SCT": "rna", "Protein": "prot", "Peaks": "atac"}
LOADINGS_OUT = {"pca": "PCs"}
COLUMNS_OUT = {"nCount_RNA": "n_counts", "nFeature_RNA": "n_genes", "percent.mt": "percent_mito", "seurat_clusters": "clusters"}
COLUMNS_OUT_DIRECT = {"nCount_RNA": "n_counts", "nFeature_RNA": "n_genes", "percent.mt": "pct_counts_mt", "orig.ident": "batch"}
FEATURE_COLUMNS_OUT = {"vst.variable": "highly_variable", "vst.mean": "means", "vst.variance": "dispersions", "vst.variance.standardized": "dispersions_norm", "vst.variance.expected": "dispersions_expected"}
SCALE_FACTORS_OUT = {"spot": "spot_diameter_fullres", "fiducial": "fiducial_diameter_fullres", "hires": "tissue_hires_scalef", "lowres": "tissue_lowres_scalef"}


def mapped(value: Column, pairs: dict[str, str], otherwise: Column | None = None) -> Column:
    """value by pairs; what isn't there stays, or becomes otherwise."""
    out = None
    for k, v in pairs.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(value if otherwise is None else otherwise)


def reduction_name(key: Column) -> Column:
    return F.regexp_replace(key, "^X_", "")


def reduction_key(name: Column) -> Column:
    return mapped(F.lower(name), REDUCTION_KEYS, F.concat(F.upper(name), F.lit("_")))


def layer_in(name: Column) -> Column:
    return mapped(name, LAYERS_IN)


def layer_out(name: Column) -> Column:
    return mapped(name, LAYERS_OUT)


def graph_in(key: Column, assay: Column) -> Column:
    """File's name of a graph to the hub's: connectivities -> <assay>_snn, distances -> <assay>_nn."""
    return F.when(key == "connectivities", F.concat(assay, F.lit("_snn"))).when(key == "distances", F.concat(assay, F.lit("_nn"))).otherwise(key)


def graph_out(key: Column, assay: Column) -> Column:
    bare = F.when(F.startswith(key, F.concat(assay, F.lit("_"))), F.substring(key, F.length(assay) + 2, F.length(key))).otherwise(key)
    return F.when(bare == "snn", "connectivities").when(bare == "nn", "distances").otherwise(bare)


def loadings_in(key: Column) -> Column:
    return F.when(key == "PCs", "pca").otherwise(F.lower(key))


def loadings_out(name: Column) -> Column:
    return F.when(name == "pca", "PCs").otherwise(F.upper(name))


def modality_to_assay(m: Column) -> Column:
    return mapped(m, MODALITY_TO_ASSAY)


def assay_to_modality(a: Column) -> Column:
    return mapped(a, ASSAY_TO_MODALITY, F.lower(a))


def standard_column(c: Column, table: str = "obs", direct: bool = False) -> Column:
    """The other tools' name of a column. The writer of whole files (direct) has a map of its own for cells."""
    return mapped(c, FEATURE_COLUMNS_OUT if table == "var" else COLUMNS_OUT_DIRECT if direct else COLUMNS_OUT)


def scale_factor(name: Column) -> Column:
    return mapped(name, SCALE_FACTORS_OUT)


def scale_value(name: Column, value: Column) -> Column:
    """Diameters become radii on the way in."""
    return F.when(name.isin("spot", "fiducial"), value / 2).otherwise(value)
