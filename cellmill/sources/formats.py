"""Registers the formats that this package reads and writes, and converts between them."""

from __future__ import annotations

import inspect

from pyspark.sql import SparkSession

from ..functions.mapping import ASSAY_TO_MODALITY, MODALITY_TO_ASSAY
from . import container, hdf5_formats, vendor, zarr
from .container import Container
from .registry import FormatError, direct, file_type, loader, register_format, saver

register_format("parquet", container.read_container, container.write_container)
register_format("zarr", zarr.read_zarr, zarr.write_zarr)
register_format("cosmx", vendor.read_cosmx)
register_format("xenium", vendor.read_xenium)
register_format("h5ad", hdf5_formats.read_h5ad, hdf5_formats.write_h5ad)
register_format("h5seurat", hdf5_formats.read_h5seurat, hdf5_formats.write_h5seurat)
register_format("h5mu", hdf5_formats.read_h5mu, hdf5_formats.write_h5mu)
register_format("gef", hdf5_formats.read_gef)
register_format("cellbin.gef", hdf5_formats.read_cellbin_gef)
register_format("spatialdata.zarr", zarr.read_spatialdata, zarr.write_spatialdata)
register_format("loom", hdf5_formats.read_loom, hdf5_formats.write_loom)


def no_soma(*_, **__):
    raise FormatError("a SOMA store is a TileDB store, whose library isn't there; convert it to h5ad or Zarr first")


register_format("soma", no_soma, no_soma)


def kind_of(spark: SparkSession, path: str) -> str:
    """file_type(), with bundles found on any store that Spark reaches."""
    web = path.lower().startswith(("soma://", "http://", "https://", "s3://", "gs://"))
    return file_type(path, (lambda _: []) if web else lambda p: container.names_in(spark, p))


def _known(call, options: dict, what: str) -> None:
    """A format that doesn't take an option says so."""
    taken = inspect.signature(call).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in taken.values()) and (unknown := sorted(options.keys() - taken.keys())):
        raise FormatError(f"{what} takes no {', '.join(unknown)}")


def load(spark: SparkSession, path: str, **options) -> Container | dict[str, Container]:
    call = loader(kind := kind_of(spark, path))
    _known(call, options, f"reading {kind}")
    return call(spark, path, **options)


def save(c: Container | dict[str, Container], path: str, overwrite: bool = False, **options) -> None:
    call = saver(kind := file_type(path))
    _known(call, options, f"writing {kind}")
    call(c, path, overwrite=overwrite, **options)


#: Formats whose readers and writers choose an assay by name.
_ASSAYS = ("h5seurat",)


def convert(spark: SparkSession, source: str, dest: str, overwrite: bool = False, assay: str | None = None, **options) -> None:
    """A direct path if one is registered, else through the hub. assay: the one to read or write, or the modality to take
    from, or to make in, a file of several."""
    kinds = kind_of(spark, source), file_type(dest)
    if source.rstrip("/") == dest.rstrip("/"):
        raise FormatError("source and destination are the same")
    if (how := direct(*kinds)) is not None:
        how(spark, source, dest, overwrite=overwrite, **options)
        return
    c = load(spark, source, **({"assay": assay} if assay and kinds[0] in _ASSAYS else {}))
    if kinds[0] == "h5mu" and kinds[1] != "h5mu":
        names = [m for m in c if assay in (None, m, MODALITY_TO_ASSAY.get(m, m))]
        if len(names) != 1:
            raise FormatError(f"{source} has {len(c)} modalities ({', '.join(c)}), {kinds[1]} holds one: name it as the assay")
        c = c[names[0]]
    if kinds[1] == "h5mu" and kinds[0] != "h5mu":
        name = assay or c.default_assay
        c = {ASSAY_TO_MODALITY.get(name, name.lower()): c}
    save(c, dest, overwrite, **options, **({"assay": assay} if assay and kinds[1] in _ASSAYS else {}))
