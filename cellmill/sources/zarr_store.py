"""Zarr arrays, versions 2 and 3: metadata, codecs, chunks. Stores are local paths or URIs that pyarrow.fs opens."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import math
import os
import struct
import zlib

import numpy as np


class ZarrError(ValueError):
    """A store that can't be read or written."""


class Store:
    """Keys to bytes under a root; picklable, so that executors open it themselves."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.remote = "://" in root and not root.startswith("file://")
        if root.startswith("file://"):
            self.root = root.removeprefix("file://").rstrip("/")

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def get(self, key: str) -> bytes | None:
        if not self.remote:
            try:
                with open(os.path.join(self.root, key), "rb") as f:
                    return f.read()
            except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
                return None
        fs, base = self._fs()
        try:
            with fs.open_input_stream(f"{base}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, key: str, value: bytes) -> None:
        if not self.remote:
            path = os.path.join(self.root, key)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(value)
            os.replace(part, path)  # a task that runs again leaves the same file
            return
        fs, base = self._fs()
        fs.create_dir(os.path.dirname(f"{base}/{key}"))
        with fs.open_output_stream(f"{base}/{key}") as f:
            f.write(value)

    def children(self, key: str = "") -> list[str]:
        if not self.remote:
            path = os.path.join(self.root, key)
            return sorted(n for n in os.listdir(path) if os.path.isdir(os.path.join(path, n))) if os.path.isdir(path) else []
        from pyarrow.fs import FileSelector, FileType

        fs, base = self._fs()
        return sorted(i.base_name for i in fs.get_file_info(FileSelector(f"{base}/{key}", allow_not_found=True)) if i.type == FileType.Directory)

    def kind(self, key: str) -> str | None:
        return kind(self, key)

    def attrs(self, key: str) -> dict:
        return attrs(self, key)

    def array(self, key: str) -> Array:
        return Array(self, key)

    def json(self, key: str) -> dict | None:
        raw = self.get(key)
        return None if raw is None else json.loads(raw)


class WebStore(Store):
    """A store that is read over HTTP: a plain address, or a bucket as s3://bucket/path or gs://bucket/path, without
    credentials. Buckets are listed page by page; at a plain address the consolidated metadata says what is there.

    endpoint: another address of the bucket's service than the public one. cache: a folder on this machine for what was
    read, under a hash of the address; each machine has its own."""

    def __init__(self, root: str, endpoint: str | None = None, cache: str | None = None):
        self.root, self.remote, self.cache = root.rstrip("/"), True, cache
        scheme, _, rest = self.root.partition("://")
        bucket, _, self.prefix = rest.partition("/")
        self.listed = scheme.lower() in ("s3", "gs")
        if self.listed:
            public = f"https://{bucket}.s3.amazonaws.com" if scheme.lower() == "s3" else f"https://storage.googleapis.com/{bucket}"
            self.service = (endpoint or public).rstrip("/")
            self.base = f"{self.service}/{self.prefix}".rstrip("/")
        else:
            self.base = self.root
        self._known: dict | None = None

    def _fetch(self, url: str) -> bytes | None:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=60) as answer:  # noqa: S310  the scheme is http or https
                return answer.read()
        except HTTPError as e:
            if e.code in (403, 404):  # buckets without a right to list answer 403 for what isn't there
                return None
            raise ZarrError(f"{url}: {e}") from e

    def get(self, key: str) -> bytes | None:
        from urllib.parse import quote

        url = f"{self.base}/{quote(key)}"
        if not self.cache:
            return self._fetch(url)
        place = os.path.join(self.cache, hashlib.md5(self.base.encode(), usedforsecurity=False).hexdigest(), key + ".bytes")
        if os.path.exists(place):
            with open(place, "rb") as f:
                return f.read()
        raw = self._fetch(url)
        if raw is not None:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            part = f"{place}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(raw)
            os.replace(part, place)
        return raw

    def put(self, key: str, value: bytes) -> None:
        raise ZarrError(f"{self.root} can only be read")

    def _names(self) -> dict:
        """Keys of the consolidated metadata."""
        if self._known is None:
            raw = self.get(".zmetadata")
            self._known = json.loads(raw)["metadata"] if raw else {}
        return self._known

    def children(self, key: str = "") -> list[str]:
        if not self.listed:
            head = f"{key}/" if key else ""
            return sorted({k[len(head) :].split("/")[0] for k in self._names() if k.startswith(head) and "/" in k[len(head) :]})
        from urllib.parse import quote
        from xml.etree import ElementTree

        head, found, token = f"{join(self.prefix, key)}/".lstrip("/"), [], None
        while True:
            url = f"{self.service}/?list-type=2&delimiter=%2F&prefix={quote(head, safe='')}" + (f"&continuation-token={quote(token, safe='')}" if token else "")
            raw = self._fetch(url)
            if raw is None:
                raise ZarrError(f"{self.service} can't be listed")
            tree = ElementTree.fromstring(raw)  # noqa: S314  an answer of the store's own service
            tag = lambda e: e.tag.rpartition("}")[2]
            for e in tree:
                if tag(e) == "CommonPrefixes":
                    found += [p.text[len(head) :].rstrip("/") for p in e if tag(p) == "Prefix"]
            token = next((e.text for e in tree if tag(e) == "NextContinuationToken"), None)
            if not token:
                return sorted(found)


def open_store(root: str, endpoint: str | None = None, cache: str | None = None) -> Store:
    """A Store, or a WebStore for addresses and buckets that are read without credentials (http, https; s3 and gs where an
    endpoint is named or ``anonymous`` is)."""
    scheme = root.partition("://")[0].lower() if "://" in root else ""
    if scheme in ("http", "https") or endpoint:
        return WebStore(root, None if endpoint == "anonymous" else endpoint, cache)
    return Store(root)


def join(*parts: str) -> str:
    return "/".join(p.strip("/") for p in parts if p)


def attrs(store: Store, key: str) -> dict:
    if (meta := store.json(join(key, "zarr.json"))) is not None:
        return meta.get("attributes", {})
    return store.json(join(key, ".zattrs")) or {}


def kind(store: Store, key: str) -> str | None:
    """array, group or None."""
    if (meta := store.json(join(key, "zarr.json"))) is not None:
        return meta["node_type"]
    return "array" if store.get(join(key, ".zarray")) is not None else "group" if store.get(join(key, ".zgroup")) is not None else None


_V3 = {"bool": "|b1", "int8": "|i1", "uint8": "|u1"} | {f"{k}{b}": f"<{c}{b // 8}" for k, c in (("int", "i"), ("uint", "u"), ("float", "f")) for b in (16, 32, 64)}


def compress(raw: bytes, codec: str | None, level: int = 1) -> bytes:
    if codec in (None, "none"):
        return raw
    if codec == "zlib":
        return zlib.compress(raw, level)
    if codec == "gzip":
        return gzip.compress(raw, level, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(raw)
    raise ZarrError(f"codec {codec!r} isn't available; there are zlib, gzip, zstd and none")


def decompress(raw: bytes, codec: str | None) -> bytes:
    if codec in (None, "none"):
        return raw
    if codec == "zlib":
        return zlib.decompress(raw)
    if codec == "gzip":
        return gzip.decompress(raw)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ZarrError(f"codec {codec!r} isn't available; there are zlib, gzip, zstd and none")


def encode_strings(values) -> bytes:
    """vlen-utf8: a count, then length and bytes of each; null has length -1."""
    out = [struct.pack("<I", len(values))]
    for v in values:
        raw = b"" if v is None else v.encode()
        out += [struct.pack("<i", -1 if v is None else len(raw)), raw]
    return b"".join(out)


def decode_strings(raw: bytes) -> list[str | None]:
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<i", raw, at)
        at += 4
        out.append(None if size < 0 else raw[at : at + size].decode())
        at += max(0, size)
    return out


class Array:
    """One array's metadata and its chunks."""

    def __init__(self, store: Store, key: str):
        self.store, self.key = store, key
        if (m := store.json(join(key, "zarr.json"))) is not None:
            if m.get("node_type") != "array":
                raise ZarrError(f"{key} is no array")
            self.version, self.shape, self.order = 3, m["shape"], "C"
            self.chunks = m["chunk_grid"]["configuration"]["chunk_shape"]
            names = [c["name"] for c in m["codecs"]]
            self.strings = m["data_type"] == "string" or "vlen-utf8" in names
            self.dtype = None if self.strings else np.dtype(self._v3(m, key))
            self.codec = next((n for n in names if n not in ("bytes", "vlen-utf8", "transpose", "crc32c")), None)
            if "crc32c" in names or "sharding_indexed" in names:
                raise ZarrError(f"{key}: codecs {names} aren't supported")
            encoding = m.get("chunk_key_encoding", {"name": "default"})
            sep = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
            self._prefix, self.sep = ("c" + sep if encoding["name"] == "default" else ""), sep
            self.fill = m.get("fill_value")
        elif (m := store.json(join(key, ".zarray"))) is not None:
            self.version, self.shape, self.chunks, self.order = 2, m["shape"], m["chunks"], m.get("order", "C")
            self.strings = m["dtype"] == "|O"
            if self.strings and not any(f["id"] == "vlen-utf8" for f in m.get("filters") or []):
                raise ZarrError(f"{key}: objects without the vlen-utf8 filter can't be read")
            if not self.strings and m.get("filters"):
                raise ZarrError(f"{key}: filters aren't supported")
            self.dtype = None if self.strings else np.dtype(m["dtype"])
            self.codec = (m.get("compressor") or {}).get("id")
            self._prefix, self.sep, self.fill = "", m.get("dimension_separator", "."), m.get("fill_value")
        else:
            raise ZarrError(f"{key}: no array")

    @staticmethod
    def _v3(m: dict, key: str) -> str:
        if m["data_type"] not in _V3:
            raise ZarrError(f"{key}: data type {m['data_type']} isn't supported")
        spec = _V3[m["data_type"]]
        endian = next((c.get("configuration", {}).get("endian") for c in m["codecs"] if c["name"] == "bytes"), "little")
        return spec.replace("<", ">") if endian == "big" else spec

    def chunk(self, index: tuple[int, ...]):
        name = (self._prefix + self.sep.join(map(str, index))) if index else (self._prefix.rstrip(self.sep) or "0")
        raw = self.store.get(join(self.key, name))
        if self.strings:
            n = math.prod(self.chunks)
            got = [self.fill if isinstance(self.fill, str) else None] * n if raw is None else decode_strings(decompress(raw, self.codec))
            return np.array(got, dtype=object).reshape(self.chunks if len(got) == n else (len(got),))
        if raw is None:  # a missing chunk holds the fill value
            fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(self.fill, self.fill) if isinstance(self.fill, str) else self.fill
            return np.full(self.chunks, fill or 0, dtype=self.dtype)
        return np.frombuffer(decompress(raw, self.codec), dtype=self.dtype).reshape(self.chunks, order=self.order)

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Rows [begin, end) of the first axis; only chunks that they touch are fetched."""
        if not self.shape:
            return self.chunk(())
        end = self.shape[0] if end is None else min(end, self.shape[0])
        rest = self.shape[1:]
        out = np.empty((max(0, end - begin), *rest), dtype=object if self.strings else self.dtype)
        if end <= begin:
            return out
        grid = [range(begin // self.chunks[0], (end - 1) // self.chunks[0] + 1), *[range(-(-s // c)) for s, c in zip(rest, self.chunks[1:], strict=True)]]
        for index in itertools.product(*grid):
            part, low = self.chunk(index), index[0] * self.chunks[0]
            a, b = max(begin, low), min(end, low + self.chunks[0])
            to, of = [slice(a - begin, b - begin)], [slice(a - low, b - low)]
            for i, c, s in zip(index[1:], self.chunks[1:], rest, strict=True):
                to.append(slice(i * c, min(s, (i + 1) * c)))
                of.append(slice(0, min(s, (i + 1) * c) - i * c))
            out[tuple(to)] = part[tuple(of)]
        return out


def write_group(store: Store, key: str, attributes: dict, version: int = 2) -> None:
    if version == 3:
        store.put(join(key, "zarr.json"), json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}).encode())
    else:
        store.put(join(key, ".zgroup"), b'{"zarr_format": 2}')
        store.put(join(key, ".zattrs"), json.dumps(attributes).encode())


def write_meta(store: Store, key: str, shape, chunks, dtype: str, codec: str | None = "zlib", level: int = 1, version: int = 2, attributes: dict | None = None, fill=None) -> None:
    """dtype: a numpy type or 'string'. fill: the value of missing chunks (JSON form)."""
    text = dtype == "string"
    if version == 3:
        names = {v: k for k, v in _V3.items()}
        codecs = [{"name": "vlen-utf8"}] if text else [{"name": "bytes", "configuration": {"endian": "little"}}]
        if codec not in (None, "none"):
            codecs.append({"name": codec, "configuration": {"level": level}})
        kind_ = "string" if text else names[np.dtype(dtype).str]
        m = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind_, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill if fill is not None else "" if text else False if kind_ == "bool" else 0, "codecs": codecs, "attributes": attributes or {}}
        store.put(join(key, "zarr.json"), json.dumps(m).encode())
        return
    m = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": "|O" if text else np.dtype(dtype).str, "compressor": None if codec in (None, "none") else {"id": codec, "level": level}, "fill_value": fill if fill is not None else "" if text else 0, "order": "C", "filters": [{"id": "vlen-utf8"}] if text else None}
    store.put(join(key, ".zarray"), json.dumps(m).encode())
    if attributes is not None:
        store.put(join(key, ".zattrs"), json.dumps(attributes).encode())


def write_chunk(store: Store, key: str, index: tuple[int, ...], values, chunks, dtype: str, codec: str | None = "zlib", level: int = 1, version: int = 2) -> None:
    """One chunk, padded to its full size."""
    if dtype == "string":
        raw = encode_strings(list(values) + [""] * (math.prod(chunks) - len(values)))
    else:
        full = np.zeros(chunks, dtype=dtype)
        full[tuple(slice(0, s) for s in np.shape(values))] = values
        raw = full.tobytes()
    name = "/".join(["c", *map(str, index)]) if version == 3 else ".".join(map(str, index)) or "0"
    store.put(join(key, name), compress(raw, codec, level))
