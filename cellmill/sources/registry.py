"""File types, formats and direct conversion paths."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that go before the plain extension, and the canonical files of vendor bundles.
DOUBLE_SUFFIXES = ("spatialdata.zarr", "cellbin.gef")
COSMX_FILES = ("_exprMat_file.csv", "_metadata_file.csv", "_fov_positions_file.csv", "_tx_file.csv")
XENIUM_FILES = ("experiment.xenium", "cell_feature_matrix.h5", "cell_feature_matrix", "cells.parquet", "transcripts.parquet", "cell_boundaries.parquet")

_loaders: dict[str, Callable] = {}
_savers: dict[str, Callable] = {}
_direct: dict[tuple[str, str], Callable] = {}


class FormatError(ValueError):
    """A format that isn't known or can't do what is asked."""


def file_type(path: str, listing: Callable[[str], list[str]] | None = None) -> str:
    """The format's name by scheme, bundle or extension. listing: names in a folder (empty if it is none); by default of
    this machine's folders."""
    if path.lower().startswith("soma://"):
        return "soma"
    bare = path.rstrip("/").lower()
    for suffix in DOUBLE_SUFFIXES:
        if bare.endswith(f".{suffix}"):
            return suffix
    if names := listing(path) if listing else os.listdir(path) if os.path.isdir(path) else []:
        if sum(any(n.endswith(s) for n in names) for s in COSMX_FILES) >= 2:
            return "cosmx"
        if sum(s in names for s in XENIUM_FILES) >= 2:
            return "xenium"
    return os.path.splitext(bare)[1].removeprefix(".")


def file_type_column(name: Column) -> Column:
    """file_type() without bundles, as an expression."""
    low = F.lower(F.regexp_replace(name, "/+$", ""))
    out = F.when(F.startswith(low, F.lit("soma://")), "soma")
    for suffix in DOUBLE_SUFFIXES:
        out = out.when(F.endswith(low, F.lit(f".{suffix}")), suffix)
    return out.otherwise(F.regexp_extract(low, r"\.([^./]*)$", 1))


def register_format(ext: str, loader: Callable | None = None, saver: Callable | None = None) -> None:
    """loader(spark, path, **options) -> Container; saver(container, path, **options)."""
    if loader:
        _loaders[ext.lower()] = loader
    if saver:
        _savers[ext.lower()] = saver


def register_direct(source: str, dest: str, convert: Callable) -> None:
    """convert(spark, source, dest, **options) goes before loading and saving."""
    _direct[source.lower(), dest.lower()] = convert


def loader(ext: str) -> Callable:
    if ext.lower() not in _loaders:
        raise FormatError(f"no reader for {ext!r}; there are {sorted(_loaders)}")
    return _loaders[ext.lower()]


def saver(ext: str) -> Callable:
    if ext.lower() not in _savers:
        raise FormatError(f"no writer for {ext!r}; there are {sorted(_savers)}")
    return _savers[ext.lower()]


def direct(source: str, dest: str) -> Callable | None:
    return _direct.get((source.lower(), dest.lower()))


def list_formats() -> dict[str, tuple[bool, bool]]:
    """Format -> (can be read, can be written)."""
    return {k: (k in _loaders, k in _savers) for k in sorted({*_loaders, *_savers})}
