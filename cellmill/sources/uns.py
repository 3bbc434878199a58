"""Unstructured metadata: rows (path, value as JSON) to and from a tree of groups and arrays.

A row is a leaf. Scalars, lists of one type and rectangular nested lists of numbers become arrays; ``{}`` an empty group;
{"encoding": ...} a frame, a sparse matrix, a categorical, a nullable column or null. What no array can hold as it stands
(lists of mixed types, large integers) is kept as JSON text with an attribute that says so, so nothing is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import zarr_store as Z

MARK = "json"
_PARTS = {
    "csr_matrix": ("data", "indices", "indptr"), "csc_matrix": ("data", "indices", "indptr"), "categorical": ("categories", "codes"), "nullable-integer": ("values", "mask"),
    "nullable-boolean": ("values", "mask"), "nullable-string-array": ("values", "mask"),
}

ENCODED = {"null", "dataframe", *_PARTS}
#: Children of a group beyond which tasks read it, parts that it is cut into at most, and rows given at once.
WIDE, RANGES, BATCH = 1000, 64, 4096

Group = Callable[[str, dict], None]
Put = Callable[[str, np.ndarray, dict], None]


def _value(tree, key: str):
    array, known = tree.array(key), tree.attrs(key)
    raw = array.read()
    if known.get("encoding-type") == MARK:
        return json.loads(np.asarray(raw).item())
    out = np.asarray(raw).tolist()
    return out


def _node(tree, key: str):
    """The JSON value of an encoded group; None if it is a plain one."""
    known = tree.attrs(key)
    kind = known.get("encoding-type")
    if kind == "null":
        return {"encoding": "null"}
    if kind in _PARTS:
        out = {"encoding": kind} | {p: _value(tree, Z.join(key, p)) for p in _PARTS[kind]}
        return out | {k: known[k] for k in ("shape", "ordered") if k in known}
    if kind == "dataframe":
        order = known.get("column-order", [])
        index = known.get("_index", "_index")
        inner = lambda c: _value(tree, Z.join(key, c)) if tree.kind(Z.join(key, c)) == "array" else _node(tree, Z.join(key, c))
        return {"encoding": "dataframe", "index": _value(tree, Z.join(key, index)), "columns": {c: inner(c) for c in order}}
    return None


def leaves(tree, key: str, path: str, skip=None) -> Iterator[tuple[str, str]]:
    """(path, value as JSON) of all that stands at a key and below it. skip: a pattern of paths that are read elsewhere."""
    if skip is not None and skip.match(path):
        return
    if tree.kind(key) == "array":
        yield path, json.dumps(_value(tree, key))
    elif (whole := _node(tree, key)) is not None:
        yield path, json.dumps(whole)
    else:
        below = tree.children(key)
        if not below and path:
            yield path, "{}"
        at = (tree.places(key) if below and hasattr(tree, "places") else None) or {}
        for name in below:
            if name in at:
                tree.known(Z.join(key, name), at[name])  # so that this group isn't listed again after large children
            yield from leaves(tree, Z.join(key, name), f"{path}/{name}" if path else name, skip)


def _work(tree, top: str, skip) -> list[tuple[str, str, list[str] | None, list[int | None] | None]]:
    """(key, path, children, places): parts of the tree of about WIDE nodes, each some of a group's children, with their
    places where the tree has such (None: all of the node). Only groups of few children are entered."""
    out: list[tuple[str, str, list[str] | None, list[int | None] | None]] = []

    def walk(key: str, path: str) -> None:
        if len(out) >= WIDE or tree.kind(key) == "array" or (skip is not None and skip.match(path)) or tree.attrs(key).get("encoding-type") in ENCODED:
            out.append((key, path, None, None))
            return
        below = tree.children(key)
        if len(below) > WIDE:
            step = max(WIDE, -(-len(below) // RANGES))
            at = (tree.places(key) if hasattr(tree, "places") else None) or {}
            for k in range(0, len(below), step):
                out.append((key, path, below[k : k + step], [at.get(name) for name in below[k : k + step]]))
        elif not below:
            out.append((key, path, None, None))
        else:
            for name in below:
                walk(Z.join(key, name), f"{path}/{name}" if path else name)

    if tree.kind(top) == "group":
        walk(top, "")
    return out


def uns_frame(spark: SparkSession, tree, top: str = "uns", skip=None) -> DataFrame:
    """The rows path, value. A tree of few nodes is read here; a larger one by tasks, each ranges of its nodes."""
    work, schema = _work(tree, top, skip), "path string, value string"

    def read(key: str, path: str, children: list[str] | None, places: list[int | None] | None) -> Iterator[tuple[str, str]]:
        if children is None:
            yield from leaves(tree, key, path, skip)
            return
        for name, at in zip(children, places, strict=True):
            if at is not None:
                tree.known(Z.join(key, name), at)  # so no task lists a wide group
            yield from leaves(tree, Z.join(key, name), f"{path}/{name}" if path else name, skip)

    if len(work) < WIDE and all(unit[2] is None for unit in work):
        return spark.createDataFrame([row for unit in work for row in read(*unit)], schema)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for unit in zip(*[part.column(k).to_pylist() for k in range(4)], strict=True):
                found = read(*unit)
                while held := list(islice(found, BATCH)):
                    yield pa.record_batch([pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.string())], ["path", "value"])

    units = spark.sparkContext.parallelize(work, min(len(work), RANGES))  # a task gets its own ones only
    return spark.createDataFrame(units, "key string, path string, children array<string>, places array<long>").mapInArrow(rows, schema)


def _array(value) -> np.ndarray | None:
    """The array that gives this value back as it is, if there is one."""
    if isinstance(value, str):
        return np.array(value, dtype=object)
    if isinstance(value, list) and value and all(isinstance(v, str) for v in value):
        return np.array([*value, None], dtype=object)[:-1]
    if value is None or value == [] or isinstance(value, dict):
        return None
    try:
        out = np.array(value)
    except ValueError:
        return None
    if out.dtype.kind not in "bif" or json.dumps(out.tolist()) != json.dumps(value):
        return None
    return out


def write_uns(rows: Iterable[tuple[str, str]], group: Group, put: Put, top: str = "uns", finish: Callable[[str], None] | None = None) -> None:
    """rows in the order of their paths. finish: called for each group after its last row (not for those of spatial
    pieces, which others add to)."""

    def text(key: str, value) -> None:
        put(key, np.array(json.dumps(value), dtype=object), {"encoding-type": MARK, "encoding-version": "0.1.0"})

    def leaf(key: str, value) -> None:
        if value == {}:
            group(key, {"encoding-type": "dict", "encoding-version": "0.1.0"})
        elif isinstance(value, dict) and value.get("encoding") == "null":
            group(key, {"encoding-type": "null", "encoding-version": "0.1.0"})
        elif isinstance(value, dict) and value.get("encoding") in _PARTS and all(_array(value.get(p)) is not None for p in _PARTS[value["encoding"]]):
            kind = value["encoding"]
            group(key, {"encoding-type": kind, "encoding-version": "0.1.0"} | {k: value[k] for k in ("shape", "ordered") if k in value})
            for p in _PARTS[kind]:
                leaf(f"{key}/{p}", value[p])
        elif isinstance(value, dict) and value.get("encoding") == "dataframe" and _array(value.get("index")) is not None:
            group(key, {"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": "_index", "column-order": list(value["columns"])})
            leaf(f"{key}/_index", value["index"])
            for name, column in value["columns"].items():
                leaf(f"{key}/{name}", column)
        elif (array := _array(value)) is not None:
            kind = {"O": "string", "b": "bool"}.get(array.dtype.kind, "numeric-scalar") if not array.shape else "string-array" if array.dtype == object else "array"
            put(key, array, {"encoding-type": kind, "encoding-version": "0.2.0"})
        else:
            text(key, value)

    group(top, {"encoding-type": "dict", "encoding-version": "0.1.0"})
    inside: list[str] = []
    for path, value in rows:
        parts = path.split("/")[:-1]
        same = next((k for k, (a, b) in enumerate(zip(inside, parts, strict=False)) if a != b), min(len(inside), len(parts)))
        while len(inside) > same:
            if finish is not None and inside[0] != "spatial":
                finish("/".join([top, *inside]))
            inside.pop()
        for name in parts[same:]:
            inside.append(name)
            group("/".join([top, *inside]), {"encoding-type": "dict", "encoding-version": "0.1.0"})
        leaf(f"{top}/{path}", json.loads(value))
