"""A small HDF5 reader and writer in pure Python, by the public file format specification.

Reads superblocks 0 to 3, object headers 1 and 2, groups by symbol table or link messages, compact, contiguous and
chunked (version 1 B-tree) data with deflate, shuffle and fletcher32, numbers, enumerations, fixed and variable strings.
Anything else raises Hdf5Error. Writes superblock 0 with symbol-table groups, contiguous data, and chunked data (deflate)
for datasets that grow side by side, in one pass.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

NONE = 0xFFFFFFFFFFFFFFFF
#: What a reader remembers: headers and paths, groups, heaps of strings.
SEEN, GROUPS, HEAPS = 10_000, 16, 8
SIGNATURE = b"\x89HDF\r\n\x1a\n"


class Hdf5Error(ValueError):
    """A file that can't be read or written."""


def _pad8(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


# --- reading -----------------------------------------------------------------------------------------------------


class _Type:
    """A datatype message: numpy type, or a string."""

    def __init__(self, raw: bytes):
        kind, bits, self.size = raw[0] & 15, int.from_bytes(raw[1:4], "little"), struct.unpack_from("<I", raw, 4)[0]
        self.text = self.variable = self.flag = False
        self.numpy: np.dtype | None = None
        self.used = 8
        order = ">" if bits & 1 else "<"
        if kind == 0:
            self.numpy = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}")
            self.used = 12
        elif kind == 1:
            self.numpy = np.dtype(f"{order}f{self.size}")
            self.used = 20
        elif kind == 3:
            self.text, self.numpy = True, np.dtype(f"S{self.size}")
        elif kind == 8:
            base = _Type(raw[8:])
            self.numpy = base.numpy
            names = raw[8 + base.used :].split(b"\0")
            self.flag = bits & 0xFFFF == 2 and {n.strip(b"\0") for n in raw[8 + base.used : 8 + base.used + 32].split(b"\0") if n} >= {b"FALSE", b"TRUE"} and bool(names)
            self.used = len(raw)
        elif kind == 9:
            if bits & 15 != 1:
                raise Hdf5Error("variable-length sequences aren't supported")
            self.text = self.variable = True
            self.numpy = np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])
        elif kind == 6:
            version, at, fields = raw[0] >> 4, 8, []
            for _ in range(bits & 0xFFFF):
                end = raw.index(b"\0", at)
                name = raw[at:end].decode()
                at = end + 1 if version == 3 else at + -(-(end + 1 - at) // 8) * 8
                width = 4 if version < 3 else max(1, (self.size.bit_length() + 7) // 8)
                offset = int.from_bytes(raw[at : at + width], "little")
                at += width + (28 if version == 1 else 0)
                member = _Type(raw[at:])
                at += member.used
                fields.append((name, member.numpy, offset))
            self.numpy = np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": [f[2] for f in fields], "itemsize": self.size})
            self.used = at
        else:
            raise Hdf5Error(f"datatype class {kind} isn't supported")


def _shape(raw: bytes) -> list[int]:
    version, rank = raw[0], raw[1]
    if version == 2 and raw[3] == 2:
        return [0]
    at = 8 if version == 1 else 4
    return list(struct.unpack_from(f"<{rank}Q", raw, at))


_type = lru_cache(1000)(_Type)


@lru_cache(1000)
def _attribute(head: bytes) -> tuple[str, _Type, list[int], int]:
    """Name, type, shape and number of values of an attribute, from what stands before them."""
    version = head[0]
    n, t, s = struct.unpack_from("<HHH", head, 2)
    p = 8 + (version == 3)
    step = (lambda x: -(-x // 8) * 8) if version == 1 else (lambda x: x)
    shape = _shape(head[p + step(n) + step(t) :])
    return head[p : p + n].split(b"\0")[0].decode(), _type(head[p + step(n) : p + step(n) + t]), shape, math.prod(shape)


def _remember(known: dict, key, value, most: int):
    """Keeps value in known, which forgets what came first, if that is few, or all."""
    if len(known) >= most:
        known.pop(next(iter(known))) if most <= GROUPS else known.clear()
    known[key] = value
    return value


class Tree:
    """A file's nodes by path. Picklable: each process opens the file itself."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self._file = None
        self._seen: dict[int, list[tuple[int, bytes]]] = {}
        self._at: dict[str, int | None] = {}
        self._groups: dict[int, dict[str, int]] = {}
        self._heaps: dict[int, dict[int, bytes]] = {}
        head = self._bytes(0, 96)
        if head[:8] != SIGNATURE:
            raise Hdf5Error(f"{path} is no HDF5 file")
        if head[8] in (0, 1):
            if head[13] != 8 or head[14] != 8:
                raise Hdf5Error("only 8-byte offsets and lengths are supported")
            self.root = struct.unpack_from("<Q", head, 24 + 32 + 8 + 4 * (head[8] == 1))[0]
        elif head[8] in (2, 3):
            self.root = struct.unpack_from("<Q", head, 36)[0]
        else:
            raise Hdf5Error(f"superblock version {head[8]} isn't supported")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_file": None, "_seen": {}, "_at": {}, "_groups": {}, "_heaps": {}}

    def _bytes(self, at: int, n: int) -> bytes:
        if self._file is None:
            self._file = open(self.path, "rb")  # noqa: SIM115  kept open for further reads
        self._file.seek(at)
        return self._file.read(n)

    def _messages(self, at: int) -> list[tuple[int, bytes]]:
        if at in self._seen:
            return self._seen[at]
        out: list[tuple[int, bytes]] = []
        head = self._bytes(at, 64)
        if head[:4] == b"OHDR":
            flags, p = head[5], 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
            width = 1 << (flags & 3)
            blocks, start = [(at + p + width, int.from_bytes(head[p : p + width], "little"))], 4 + 2 * bool(flags & 4)
            while blocks:
                b, n = blocks.pop(0)
                raw, p = self._bytes(b, n), 0
                while p + start <= n:
                    kind, size = raw[p], struct.unpack_from("<H", raw, p + 1)[0]
                    body = raw[p + start : p + start + size]
                    p += start + size
                    if kind == 16:
                        to, length = struct.unpack("<QQ", body[:16])
                        blocks.append((to + 4, length - 8))
                    else:
                        out.append((kind, body))
        elif head[0] == 1:
            count, blocks = struct.unpack_from("<H", head, 2)[0], [(at + 16, struct.unpack_from("<I", head, 8)[0])]
            while blocks:
                b, n = blocks.pop(0)
                raw, p = self._bytes(b, n), 0
                while p + 8 <= n and count > 0:
                    kind, size = struct.unpack_from("<HH", raw, p)
                    body = raw[p + 8 : p + 8 + size]
                    p, count = p + 8 + size, count - 1
                    if kind == 16:
                        blocks.append(struct.unpack("<QQ", body[:16]))
                    else:
                        out.append((kind, body))
        else:
            raise Hdf5Error(f"no object header at {at}")
        return _remember(self._seen, at, out, SEEN)

    def _links(self, at: int) -> dict[str, int]:
        if at in self._groups:
            self._groups[at] = out = self._groups.pop(at)  # what was used last is forgotten last
            return out
        out: dict[str, int] = {}
        for kind, body in self._messages(at):
            if kind == 17:
                tree, heap = struct.unpack("<QQ", body[:16])
                size, names = struct.unpack_from("<Q8xQ", self._bytes(heap, 32), 8)
                self._symbols(tree, self._bytes(names, size), out)
            elif kind == 6:
                flags, p = body[1], 2
                hard = not flags & 8 or body[p] == 0
                p += bool(flags & 8) + (8 if flags & 4 else 0) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[p : p + width], "little")
                name = body[p + width : p + width + n].decode()
                if hard:
                    out[name] = struct.unpack_from("<Q", body, p + width + n)[0]
            elif kind == 2:
                p = 2 + 8 * (body[1] & 1)
                if struct.unpack_from("<Q", body, p)[0] != NONE:
                    raise Hdf5Error("groups with dense link storage aren't supported")
        return _remember(self._groups, at, out, GROUPS)

    def _symbols(self, at: int, names: bytes, out: dict[str, int]) -> None:
        head = self._bytes(at, 8)
        if head[:4] == b"TREE":
            n = struct.unpack_from("<H", head, 6)[0]
            raw = self._bytes(at + 24, 16 * n + 8)
            for k in range(n):
                self._symbols(struct.unpack_from("<Q", raw, 8 + 16 * k)[0], names, out)
            return
        n = struct.unpack_from("<H", head, 6)[0]
        raw = self._bytes(at + 8, 40 * n)
        for k in range(n):
            name, to = struct.unpack_from("<QQ", raw, 40 * k)
            out[names[name : names.index(b"\0", name)].decode()] = to

    def _find(self, key: str) -> int | None:
        if key in self._at:
            return self._at[key]
        above, _, name = key.rpartition("/")
        at = self._find(above) if above else self.root
        return self.known(key, self._links(at).get(name) if name and at is not None else at)

    def places(self, key: str) -> dict[str, int]:
        """Where the children of a group stand."""
        at = self._find(key)
        return {} if at is None or self.kind(key) == "array" else self._links(at)

    def known(self, key: str, at: int | None) -> int | None:
        """Notes where a node stands."""
        return _remember(self._at, key, at, SEEN)

    def kind(self, key: str) -> str | None:
        at = self._find(key)
        return None if at is None else "array" if any(k == 8 for k, _ in self._messages(at)) else "group"

    def children(self, key: str = "") -> list[str]:
        at = self._find(key)
        return [] if at is None or self.kind(key) == "array" else sorted(self._links(at))

    def attrs(self, key: str) -> dict:
        at, out = self._find(key), {}
        for kind, body in self._messages(at) if at is not None else []:
            if kind != 12:
                continue
            n, t, d = struct.unpack_from("<HHH", body, 2)
            p = 8 - (-n // 8 + -t // 8 + -d // 8) * 8 if body[0] == 1 else 8 + (body[0] == 3) + n + t + d
            name, type_, shape, count = _attribute(body[:p])
            values = np.frombuffer(body, type_.numpy, count, p).reshape(shape)
            values = self.decode(values, type_)
            out[name] = values.tolist() if shape else values.reshape(-1)[0].item() if hasattr(values.reshape(-1)[0], "item") else values.reshape(-1)[0]
        return out

    def decode(self, values: np.ndarray, type_: _Type) -> np.ndarray:
        if type_.variable:
            flat = [self._heap(int(v["at"])).get(int(v["k"]), b"")[: int(v["n"])].decode() if v["at"] not in (0, NONE) else "" for v in values.reshape(-1)]
            return np.array([*flat, None], dtype=object)[:-1].reshape(values.shape)
        if type_.text:
            return np.array([*[v.split(b"\0")[0].decode() for v in values.reshape(-1).tolist()], None], dtype=object)[:-1].reshape(values.shape)
        return values.astype(bool) if type_.flag else values

    def _heap(self, at: int) -> dict[int, bytes]:
        if at not in self._heaps:
            size = struct.unpack_from("<Q", self._bytes(at, 16), 8)[0]
            raw, p, own = self._bytes(at, size), 16, {}
            while p + 16 <= size:
                k, _, n = struct.unpack_from("<HHxxxxQ", raw, p)
                if k == 0:
                    break
                own[k] = raw[p + 16 : p + 16 + n]
                p += 16 + -(-n // 8) * 8
            return _remember(self._heaps, at, own, HEAPS)
        return self._heaps[at]

    def array(self, key: str) -> Dataset:
        if self.kind(key) != "array":
            raise Hdf5Error(f"{key}: no dataset")
        return Dataset(self, key, self._messages(self._find(key)))


class Dataset:
    def __init__(self, tree: Tree, key: str, messages: list[tuple[int, bytes]]):
        self.tree, self.key = tree, key
        found = dict(reversed(messages))
        self.shape, self.type = _shape(found[1]), _type(found[3])
        self.strings, self.dtype = self.type.text, np.dtype(bool) if self.type.flag else self.type.numpy
        self.filters: list[int] = []
        if 11 in found:
            raw, p = found[11], 8 if found[11][0] == 1 else 2
            for _ in range(raw[1]):
                kind, p = struct.unpack_from("<H", raw, p)[0], p + 2
                n = 0
                if raw[0] == 1 or kind >= 256:
                    n, p = struct.unpack_from("<H", raw, p)[0], p + 2
                values = struct.unpack_from("<H", raw, p + 2)[0]
                p += 4 + (-(-n // 8) * 8 if raw[0] == 1 else n) + 4 * values + (4 * (values % 2) if raw[0] == 1 else 0)
                if kind not in (1, 2, 3):
                    raise Hdf5Error(f"{key}: filter {kind} isn't supported")
                self.filters.append(kind)
        layout = found[8]
        if layout[0] != 3:
            raise Hdf5Error(f"{key}: layout version {layout[0]} isn't supported")
        self.how = layout[1]
        if self.how == 0:
            self.compact = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
        elif self.how == 1:
            self.address = struct.unpack_from("<Q", layout, 2)[0]
        else:
            self.address = struct.unpack_from("<Q", layout, 3)[0]
            self.chunks = list(struct.unpack_from(f"<{layout[2] - 1}I", layout, 11))

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Rows [begin, end) of the first axis; only their bytes or chunks are read."""
        t = self.type.numpy
        if not self.shape:
            raw = self.compact if self.how == 0 else self.tree._bytes(self.address, t.itemsize)
            return self.tree.decode(np.frombuffer(raw, t, 1).reshape(()), self.type)
        end = self.shape[0] if end is None else min(end, self.shape[0])
        shape = [max(0, end - begin), *self.shape[1:]]
        row = math.prod(self.shape[1:])
        if self.how < 2:
            if self.how == 1 and self.address == NONE:
                return self.tree.decode(np.zeros(shape, t), self.type)
            raw = self.compact[begin * row * t.itemsize :] if self.how == 0 else self.tree._bytes(self.address + begin * row * t.itemsize, shape[0] * row * t.itemsize)
            return self.tree.decode(np.frombuffer(raw, t, math.prod(shape)).reshape(shape), self.type)
        out = np.zeros(shape, t)
        for offsets, part in self._parts(begin, end) if shape[0] else []:
            to, of = [], []
            for axis, (o, c) in enumerate(zip(offsets, self.chunks, strict=True)):
                low, high = (begin, end) if axis == 0 else (0, self.shape[axis])
                a, b = max(o, low), min(o + c, high)
                to.append(slice(a - low, b - low))
                of.append(slice(a - o, b - o))
            out[tuple(to)] = part[tuple(of)]
        return self.tree.decode(out, self.type)

    def entries(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, columns and values of what isn't 0 in rows [begin, end) of a matrix; only chunks that exist are looked
        at, one at a time."""
        end = min(end, self.shape[0])
        if self.how < 2:
            yield from slices(self, begin, end)
            return
        for (row, col), part in self._parts(begin, end):
            part = part[max(0, begin - row) : end - row, : self.shape[1] - col]
            i, j = np.nonzero(part)
            yield i + max(row, begin), j + col, part[i, j]

    def _parts(self, begin: int, end: int):
        """Offsets and values of the chunks that have rows in [begin, end)."""
        t = self.type.numpy
        for offsets, size, mask, at in self._chunks(self.address, begin, end) if self.address != NONE else []:
            raw = self.tree._bytes(at, size)
            for k in reversed(range(len(self.filters))):
                if mask >> k & 1:
                    continue
                if self.filters[k] == 1:
                    raw = zlib.decompress(raw)
                elif self.filters[k] == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(t.itemsize, -1).T.tobytes()
                else:
                    raw = raw[:-4]
            yield offsets, np.frombuffer(raw, t, math.prod(self.chunks)).reshape(self.chunks)

    def _chunks(self, at: int, begin: int, end: int):
        head = self.tree._bytes(at, 24)
        if head[:4] != b"TREE":
            raise Hdf5Error(f"{self.key}: no chunk index at {at}")
        level, n, rank = head[5], struct.unpack_from("<H", head, 6)[0], len(self.chunks)
        width = 8 + 8 * (rank + 1)
        raw = self.tree._bytes(at + 24, n * (width + 8) + width)
        for k in range(n):
            p = k * (width + 8)
            size, mask = struct.unpack_from("<II", raw, p)
            offsets = struct.unpack_from(f"<{rank}Q", raw, p + 8)
            child = struct.unpack_from("<Q", raw, p + width)[0]
            after = struct.unpack_from("<Q", raw, p + width + 8 + 8)[0]
            if level:
                if offsets[0] < end and (k + 1 == n or after + self.chunks[0] > begin):
                    yield from self._chunks(child, begin, end)
            elif offsets[0] < end and offsets[0] + self.chunks[0] > begin:
                yield offsets, size, mask, child


#: Values of a dense matrix that are read at once.
AT_ONCE = 1 << 22


def slices(array, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dataset.entries() of any matrix, a few rows at a time."""
    step = max(1, AT_ONCE // max(1, array.shape[1]), (getattr(array, "chunks", None) or [1])[0])  # a chunk is read once
    for a in range(begin, end, step):
        dense = array.read(a, min(end, a + step))
        i, j = np.nonzero(dense)
        yield i + a, j, dense[i, j]


# --- writing -----------------------------------------------------------------------------------------------------

#: Half of the names of a leaf and of the branches of a node in a group's tree; bytes of a heap of short strings.
LEAF, BRANCH, SMALL = 4, 16, 1 << 16


class Writer:
    """Writes datasets as their parts come, and groups at the end. Use as a context manager; the file appears complete."""

    small = SMALL

    def __init__(self, path: str, level: int = 0):
        """level: of deflate, for datasets that grow (0: none)."""
        self.path, self.tmp, self.level = path, f"{path}.{os.getpid()}.part", level
        self.file = open(self.tmp, "wb")  # noqa: SIM115  closed by __exit__
        self.file.write(b"\0" * 96)
        self.nodes: dict[str, dict] = {"": {"attrs": {}, "at": None}}
        self.inside: dict[str, list[str]] = {"": []}
        self.heap, self.objects, self.room = -1, [], 0

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._finish()
        self.file.close()
        os.replace(self.tmp, self.path) if kind is None else os.unlink(self.tmp)

    def _put(self, raw: bytes, *addresses: int) -> int:
        """Appends; addresses: places in raw that hold addresses of the file."""
        at = self.file.seek(0, 2)
        if pad := -at % 8:
            self.file.write(b"\0" * pad)
            at += pad
        self.file.write(raw)
        return at

    def _more(self, raw: bytes) -> None:
        self.file.write(raw)

    def _over(self, at: int, raw: bytes, *addresses: int) -> None:
        """Writes where room was taken before."""
        self.file.seek(at)
        self.file.write(raw)

    def group(self, key: str, attributes: dict | None = None) -> None:
        if key not in self.nodes:
            self.group(key.rpartition("/")[0])
            self._add(key, {"attrs": {}, "at": None})
            self.inside[key] = []
        if attributes:
            self.nodes[key]["attrs"] |= attributes

    def _add(self, key: str, node: dict) -> None:
        if key not in self.nodes:
            self.inside[key.rpartition("/")[0]].append(key.rpartition("/")[2])
        self.nodes[key] = node

    def finish(self, key: str) -> None:
        """Writes a group to which nothing will be added, and forgets what is in it."""
        node, data, offsets = self.nodes[key], bytearray(8), {}
        names = sorted(self.inside.pop(key), key=str.encode)
        own = [f"{key}/{n}" if key else n for n in names]
        for k in own:
            if self.nodes[k]["at"] is None:
                self.finish(k)
        for n in names:
            offsets[n] = len(data)
            data += _pad8(n.encode() + b"\0")
        heap = self._put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(data), 1, self._put(bytes(data))), 24)
        # a tree over leaves of 2 * LEAF names; (last name, place) of each node of a level
        level = []
        for a in range(0, max(1, len(names)), 2 * LEAF):
            part = names[a : a + 2 * LEAF]
            rows = b"".join(struct.pack("<QQII16x", offsets[n], self.nodes[k]["at"], 0, 0) for n, k in zip(part, own[a : a + 2 * LEAF], strict=True))
            level.append((offsets[part[-1]] if part else 0, self._put((struct.pack("<4sBBH", b"SNOD", 1, 0, len(part)) + rows).ljust(8 + 80 * LEAF, b"\0"), *range(16, 16 + 40 * len(part), 40))))
        size, depth = 24 + 8 + 32 * BRANCH, 0
        while True:
            groups = [level[k : k + 2 * BRANCH] for k in range(0, len(level), 2 * BRANCH)]
            at, before, above = self._put(b"\0" * (size * len(groups))), 0, []
            for k, nodes in enumerate(groups):
                left, right = at + (k - 1) * size if k else NONE, at + (k + 1) * size if k + 1 < len(groups) else NONE
                body = struct.pack("<Q", before) + b"".join(struct.pack("<QQ", place, last) for last, place in nodes) if names else b""
                addresses = [x for x, side in ((8, left), (16, right)) if side != NONE] + [*range(32, 32 + 16 * len(nodes), 16)] * bool(names)
                self._over(at + k * size, struct.pack("<4sBBHQQ", b"TREE", 0, depth, len(nodes) if names else 0, left, right) + body, *addresses)
                before = nodes[-1][0]
                above.append((before, at + k * size))
            level, depth = above, depth + 1
            if len(level) == 1:
                break
        link = struct.pack("<QQ", level[0][1], heap)
        for k in own:
            del self.nodes[k]
        self.nodes[key] = {"at": self._header([(17, link, (0, 8)), *self._attributes(node["attrs"])]), "link": link}

    def dataset(self, key: str, parts: Iterable[np.ndarray], shape: list[int], dtype: str, attributes: dict | None = None) -> None:
        """dtype: a numpy type or 'string'; parts in order of the first axis."""
        self.group(key.rpartition("/")[0])
        count, text = 0, dtype == "string"
        if text:
            refs = b"".join(self._strings(list(p)) for p in parts)
            count, at = len(refs) // 16, self._put(refs, *range(4, len(refs), 16))
            type_, size = _VLEN, len(refs)
        else:
            at, np_type = self._put(b""), np.dtype("u1" if dtype == "bool" else dtype)
            for p in parts:
                raw = np.ascontiguousarray(p, np_type).tobytes()
                self._more(raw)
                count += len(raw) // np_type.itemsize
            type_, size = _BOOL if dtype == "bool" else _number(np_type), count * np_type.itemsize
        if count != math.prod(shape):
            raise Hdf5Error(f"{key}: {count} values for shape {shape}")
        layout = struct.pack("<BBQQ", 3, 1, at if size else NONE, size)
        messages = [(1, _space(shape)), (3, type_), (5, b"\x02\x01\x00\x00"), (8, layout, (2,) if size else ())]
        self._add(key, {"at": self._header(messages + self._attributes(attributes or {}))})

    def grow(self, key: str, dtype: str, tail: tuple[int, ...] = (), attributes: dict | None = None) -> Growing:
        """A dataset whose rows come a part at a time, while others grow too; close() it when all have come."""
        self.group(key.rpartition("/")[0])
        return Growing(self, key, dtype, tail, attributes or {})

    def _strings(self, values: list[str | None]) -> bytes:
        if len(values) <= 16 and sum(map(len, filter(None, values))) < SMALL // 64:
            return b"".join(self._string(("" if v is None else v).encode()) for v in values)
        refs = []
        for k in range(0, len(values), 4000):
            part, body = values[k : k + 4000], []
            raws = [("" if v is None else v).encode() for v in part]
            for i, raw in enumerate(raws):
                body.append(struct.pack("<HHxxxxQ", i + 1, 1, len(raw)) + _pad8(raw))
            data = b"".join(body)
            size = max(4096, 16 + len(data) + 16)
            free = size - 16 - len(data)
            at = self._put(b"GCOL\x01\0\0\0" + struct.pack("<Q", size) + data + struct.pack("<HHxxxxQ", 0, 0, free) + b"\0" * (free - 16))
            refs += [struct.pack("<IQI", len(raw), at, i + 1) for i, raw in enumerate(raws)]
        return b"".join(refs)

    def _string(self, raw: bytes) -> bytes:
        """A short string, in a heap that many share; its place is taken when it is begun."""
        if (need := 16 + len(_pad8(raw))) > self.room:
            self._close_heap()
            self.heap, self.room = self._put(b"\0" * self.small), self.small - 16
        self.room -= need
        self.objects.append(struct.pack("<HHxxxxQ", len(self.objects) + 1, 1, len(raw)) + _pad8(raw))
        return struct.pack("<IQI", len(raw), self.heap, len(self.objects))

    def _close_heap(self) -> None:
        if self.objects:
            rest = struct.pack("<HHxxxxQ", 0, 0, self.room) if self.room >= 16 else b""
            self._over(self.heap, b"GCOL\x01\0\0\0" + struct.pack("<Q", self.small) + b"".join(self.objects) + rest)
        self.objects, self.room = [], 0

    def _attributes(self, attributes: dict) -> list[tuple[int, bytes, range]]:
        out = []
        for name, value in attributes.items():
            if isinstance(value, str):
                head = _text_attribute(name)
                out.append((12, head + self._strings([value]), range(len(head) + 4, len(head) + 5)))
                continue
            array = np.array(value, dtype=object if isinstance(value, list) and (not value or isinstance(value[0], str)) else None)
            if array.dtype == object:
                type_, data = _VLEN, self._strings(list(array.reshape(-1)))
            elif array.dtype == bool:
                type_, data = _BOOL, array.astype("u1").tobytes()
            else:
                type_, data = _number(array.dtype), array.tobytes()
            head = _attribute_head(name, type_, array.shape)
            out.append((12, head + data, range(len(head) + 4, len(head) + len(data), 16) if array.dtype == object else range(0)))
        return out

    def _header(self, messages: list[tuple]) -> int:
        """messages: kind, body and, if it holds addresses, their places in it."""
        body, addresses = [], []
        size = 16
        for kind, raw, *own in messages:
            raw = _pad8(raw)
            addresses += [size + 8 + x for x in own[0]] if own else ()
            body += (struct.pack("<HHBxxx", kind, len(raw), 0), raw)
            size += 8 + len(raw)
        return self._put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, size - 16) + b"".join(body), *addresses)

    def take(self, raw: bytes, addresses: np.ndarray, groups: list, nodes: list) -> None:
        """Appends what a Segment has made, see Segment.close()."""
        base, data = self._put(b""), np.frombuffer(bytearray(raw), np.uint8)
        for k in range(0, len(addresses), 1 << 16):
            at = addresses[k : k + (1 << 16), None] + np.arange(8)
            data[at] = (data[at].view("<u8") + np.uint64(base)).view(np.uint8)
        self.file.write(data)
        for key, attributes in groups:
            self.group(key, attributes)
        for key, at in nodes:
            self._add(key, {"at": base + at})

    def _finish(self) -> None:
        self.finish("")
        self._close_heap()
        end = self.file.seek(0, 2)
        self.file.seek(0)
        self.file.write(SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, LEAF, BRANCH, 0) + struct.pack("<QQQQ", 0, NONE, end, NONE) + struct.pack("<QQII", 0, self.nodes[""]["at"], 1, 0) + self.nodes[""]["link"])


class Segment(Writer):
    """What a Writer writes, in memory, as a piece that take() puts anywhere into a file."""

    def __init__(self, small: int = SMALL):
        self.small, self.raw, self.addresses = small, bytearray(), []
        self.nodes, self.inside = {"": {"attrs": {}, "at": None}}, {"": []}
        self.heap, self.objects, self.room = -1, [], 0

    def _put(self, raw: bytes, *addresses: int) -> int:
        self.raw += b"\0" * (-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += raw
        self.addresses += [at + x for x in addresses]
        return at

    def _more(self, raw: bytes) -> None:
        self.raw += raw

    def _over(self, at: int, raw: bytes, *addresses: int) -> None:
        self.raw[at : at + len(raw)] = raw
        self.addresses += [at + x for x in addresses]

    def close(self) -> tuple[bytes, bytes, str]:
        """The bytes, the places of addresses that count from their begin, both deflated, and as JSON the groups that are
        open (key, attributes) and what is complete in them (key, place)."""
        self._close_heap()
        steps = np.diff(np.sort(np.array(self.addresses, np.int64)), prepend=0).astype("<u4")
        groups = [(k, n["attrs"]) for k, n in self.nodes.items() if n["at"] is None]
        nodes = [(k, n["at"]) for k, n in self.nodes.items() if n["at"] is not None]
        return zlib.compress(self.raw, 1), zlib.compress(steps.tobytes(), 1), json.dumps((groups, nodes))


class Growing:
    """Rows are kept until a chunk of CHUNK values is full; chunks are appended to the file, their index at the end."""

    CHUNK, FANOUT = 1 << 16, 64

    def __init__(self, w: Writer, key: str, dtype: str, tail: tuple[int, ...], attributes: dict):
        self.w, self.key, self.tail, self.attributes = w, key, tail, attributes
        self.text = dtype == "string"
        self.type = _VLEN if self.text else _BOOL if dtype == "bool" else _number(np.dtype(dtype))
        self.width = 16 if self.text else np.dtype("u1" if dtype == "bool" else dtype).itemsize
        self.numpy = None if self.text else np.dtype("u1" if dtype == "bool" else dtype)
        self.row = self.width * math.prod(tail)
        self.rows = max(1, self.CHUNK // max(1, math.prod(tail)))
        self.held, self.size, self.count = [], 0, 0
        self.chunks: list[tuple[int, int, int]] = []  # first row, bytes, place

    def add(self, part) -> None:
        """An array, or a list of strings."""
        raw = self.w._strings(list(part)) if self.text else np.ascontiguousarray(part, self.numpy).tobytes()
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.rows * self.row:
            raw = b"".join(self.held)
            whole = len(raw) // (self.rows * self.row) * (self.rows * self.row)
            for at in range(0, whole, self.rows * self.row):
                self._chunk(raw[at : at + self.rows * self.row])
            self.held, self.size = [raw[whole:]], len(raw) - whole

    def _chunk(self, raw: bytes) -> None:
        if self.w.level:
            raw = zlib.compress(raw, self.w.level)
        self.chunks.append((self.count, len(raw), self.w._put(raw)))
        self.count += self.rows

    def close(self) -> int:
        """Writes what is left, the index and the header; returns the number of rows."""
        rest, before = b"".join(self.held), self.count
        if self.row == 0 or (not self.chunks and not (self.w.level and rest)):  # all of it at once
            rows = len(rest) // self.row if self.row else 0
            layout, fill = struct.pack("<BBQQ", 3, 1, self.w._put(rest) if rest else NONE, len(rest)), b"\x02\x01\x00\x00"
            messages = []
        else:
            rows = before + len(rest) // self.row
            if not self.chunks:
                self.rows = rows  # a chunk isn't larger than its dataset
            if rest:
                self._chunk(rest.ljust(self.rows * self.row, b"\0"))
            chunk = [self.rows, *self.tail]
            layout = struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, self._index(len(chunk)), *chunk, self.width)
            fill = b"\x02\x03\x00\x00"
            messages = [(11, struct.pack("<BB6xHHHHII", 1, 1, 1, 0, 1, 1, self.w.level, 0))] if self.w.level else []
        head = [(1, _space([rows, *self.tail])), (3, self.type), (5, fill), (8, layout), *messages]
        self.w._add(self.key, {"at": self.w._header(head + self.w._attributes(self.attributes))})
        return rows

    def _index(self, rank: int) -> int:
        """A version 1 B-tree over the chunks, level by level; the place of its root."""
        row = lambda first, size: struct.pack(f"<II{rank + 1}Q", size, 0, *(first if isinstance(first, tuple) else (first, *[0] * (rank - 1))), 0)
        width, level, nodes = 8 + 8 * (rank + 1), 0, self.chunks
        while True:
            groups = [nodes[k : k + self.FANOUT] for k in range(0, len(nodes), self.FANOUT)]
            room = 24 + (self.FANOUT + 1) * width + self.FANOUT * 8
            room += -room % 8
            at = self.w._put(b"\0" * (room * len(groups)))
            for k, own in enumerate(groups):
                after = groups[k + 1][0][0] if k + 1 < len(groups) else self.count
                body = b"".join(row(first, size) + struct.pack("<Q", place) for first, size, place in own) + row(after, 0)
                left, right = at + (k - 1) * room if k else NONE, at + (k + 1) * room if k + 1 < len(groups) else NONE
                self.w.file.seek(at + k * room)
                self.w.file.write(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(own), left, right) + body)
            nodes, level = [(own[0][0], own[0][1], at + k * room) for k, own in enumerate(groups)], level + 1
            if len(nodes) == 1:
                return nodes[0][2]


class Tiles(Growing):
    """A matrix of doubles in deflated tiles, in any order; tiles that aren't given are 0 and take no room."""

    SIDE = 128

    def __init__(self, w: Writer, key: str, shape: tuple[int, int]):
        super().__init__(w, key, "<f8", (), {})
        self.shape, self.tile = shape, tuple(max(1, min(self.SIDE, x)) for x in shape)
        w.group(key.rpartition("/")[0])

    def put(self, row: int, col: int, raw: bytes) -> None:
        """raw: zlib.compress() of the tile whose first value stands at this place."""
        self.chunks.append(((row, col), len(raw), self.w._put(raw)))

    def close(self) -> int:
        self.chunks.sort()
        self.count = (-(-self.shape[0] // self.tile[0]) * self.tile[0], 0)
        at = self._index(2) if self.chunks else NONE
        layout = struct.pack("<BBBQ3I", 3, 2, 3, at, *self.tile, 8)
        deflate = struct.pack("<BB6xHHHHII", 1, 1, 1, 0, 1, 1, max(1, self.w.level), 0)
        self.w._add(self.key, {"at": self.w._header([(1, _space(list(self.shape))), (3, self.type), (5, b"\x02\x03\x00\x00"), (8, layout), (11, deflate)])})
        return self.shape[0]


def _space(shape: list[int]) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def _number(t: np.dtype) -> bytes:
    if t.kind == "f":
        exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[t.itemsize]
        return struct.pack("<BBBBI", 0x11, 0x20, t.itemsize * 8 - 1, 0, t.itemsize) + struct.pack("<HHBBBBI", 0, t.itemsize * 8, mantissa, exponent, 0, mantissa, bias)
    return struct.pack("<BBBBI", 0x10, 8 if t.kind == "i" else 0, 0, 0, t.itemsize) + struct.pack("<HH", 0, t.itemsize * 8)


_VLEN = struct.pack("<BBBBI", 0x19, 0x01, 0x01, 0, 16) + struct.pack("<BBBBI", 0x10, 0, 0, 0, 1) + struct.pack("<HH", 0, 8)
_BOOL = struct.pack("<BBBBI", 0x18, 2, 0, 0, 1) + _number(np.dtype("i1")) + _pad8(b"FALSE\0") + _pad8(b"TRUE\0") + b"\0\x01"


def _attribute_head(name: str, type_: bytes, shape: tuple[int, ...]) -> bytes:
    space, label = _space(list(shape)), name.encode() + b"\0"
    return struct.pack("<BBHHH", 1, 0, len(label), len(type_), len(space)) + _pad8(label) + _pad8(type_) + _pad8(space)


_text_attribute = lru_cache(1000)(lambda name: _attribute_head(name, _VLEN, ()))
