"""Views that show other layouts as the AnnData tree, so that one reader serves all of them.

A view answers kind, attrs, children and array for the keys X, layers/<l>, obs, var, obsm/<k>, varm/<k>, obsp/<k>, varp/<k>
and uns of the AnnData layout.
"""

from __future__ import annotations

import numpy as np

from ..functions import mapping as M
from ..operators.joins import DataError
from . import zarr_store as Z

#: Where a writer of this package notes which rows of a column are null, where the layout has no place for it.
NULLS = "cellmill/nulls"


class Mapped:
    """An array whose values pass a function."""

    def __init__(self, inner, apply, dtype):
        self.inner, self.apply, self.dtype = inner, apply, np.dtype(dtype)
        self.shape, self.strings = inner.shape, False

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        return self.apply(self.inner.read(begin, end)).astype(self.dtype)


class Names:
    """Made-up names."""

    def __init__(self, stem: str, n: int):
        self.stem, self.shape, self.strings, self.dtype = stem, [n], True, None

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.shape[0] if end is None else min(end, self.shape[0])
        return np.array([*[f"{self.stem}{k + 1}" for k in range(begin, end)], None], dtype=object)[:-1]


class View:
    """key -> ("group", attrs, children) or ("array", a function that opens it, attrs)."""

    def __init__(self, tree):
        self.tree, self.nodes = tree, {}
        self.group("")
        for top in ("layers", "obsm", "varm", "obsp", "varp", "uns"):
            self.group(top)

    def group(self, key: str, attrs: dict | None = None) -> None:
        self.nodes[key] = ("group", None, attrs or {})

    def put(self, key: str, real: str, attrs: dict | None = None, wrap=None) -> None:
        self.nodes[key] = ("array", (real, wrap), attrs or {})

    def link(self, key: str, real: str) -> None:
        """key shows the whole node real of the file."""
        if self.tree.kind(real) == "array":
            self.put(key, real, self.tree.attrs(real))
        else:
            self.group(key, self.tree.attrs(real))
            for name in self.tree.children(real):
                self.link(Z.join(key, name), Z.join(real, name))

    def kind(self, key: str) -> str | None:
        return self.nodes[key][0] if key in self.nodes else None

    def attrs(self, key: str) -> dict:
        return self.nodes[key][2] if key in self.nodes else {}

    def children(self, key: str = "") -> list[str]:
        head = f"{key}/" if key else ""
        return sorted(k[len(head) :] for k in self.nodes if k.startswith(head) and k != key and "/" not in k[len(head) :])

    def array(self, key: str):
        _, (real, wrap), _ = self.nodes[key]
        if isinstance(real, Names):
            return real
        inner = self.tree.array(real)
        return wrap(inner) if wrap else inner

    def column(self, key: str, real: str) -> None:
        """A column of a frame: a factor of 1-based values and levels, a logical with 2 for null, or plain."""
        t = self.tree
        if t.kind(real) == "group":
            self.group(key, {"encoding-type": "categorical", "ordered": bool(t.attrs(real).get("ordered", False))})
            self.put(f"{key}/categories", f"{real}/levels")
            self.put(f"{key}/codes", f"{real}/values", wrap=lambda a: Mapped(a, lambda v: np.nan_to_num(v).astype(np.int64) - 1, "<i8"))
            return
        values, mask = (real, None), None
        if t.attrs(real).get("s3class") == "logical":
            values = (real, lambda a: Mapped(a, lambda v: v == 1, bool))
            mask = (real, lambda a: Mapped(a, lambda v: v == 2, bool))
        elif t.kind(f"{NULLS}/{real}") == "array":
            mask = (f"{NULLS}/{real}", None)
        if mask is None:
            self.put(key, *values[:1], wrap=values[1])
        else:
            self.group(key, {"encoding-type": "nullable"})
            self.put(f"{key}/values", values[0], wrap=values[1])
            self.put(f"{key}/mask", mask[0], wrap=mask[1])

    def frame(self, top: str, columns: dict[str, str], names: tuple) -> None:
        self.group(top, {"_index": "_index", "column-order": list(columns)})
        self.nodes[f"{top}/_index"] = ("array", names, {})
        for name, real in columns.items():
            self.column(f"{top}/{name}", real)


class SeuratView(View):
    """One assay of an h5Seurat file: layers (data is X), cell and feature tables, reductions, graphs, misc."""

    def __init__(self, tree, assay: str | None = None):
        super().__init__(tree)
        assays = tree.children("assays")
        if not assays or tree.kind("cell.names") != "array":
            raise DataError(f"{tree.path} has no assays or cell names")
        name = assay or tree.attrs("").get("active.assay") or assays[0]
        if name not in assays:
            raise DataError(f"{tree.path} has no assay {name}; there are {assays}")
        at = f"assays/{name}"
        features = next((f"{at}/{f}" for f in ("features", "meta.data/_index") if tree.kind(f"{at}/{f}") == "array"), None)
        if features is None:
            raise DataError(f"{tree.path}: assay {name} has no features")
        n, p = tree.array("cell.names").shape[0], tree.array(features).shape[0]
        self.nodes[""] = ("group", None, {"assay": name, "project": str(tree.attrs("").get("project", ""))})
        held = {k: Z.join(at, k) for k in tree.children(at)}
        if "layers" in held:  # newer files keep layers in a group of their own
            held |= {k: Z.join(at, "layers", k) for k in tree.children(held.pop("layers"))}
        held = {k: v for k, v in held.items() if k not in ("features", "meta.features", "meta.data", "misc", "variable.features", "scaled.features") and self._matrix(v)}
        first = "data" if "data" in held else "counts" if "counts" in held else next(iter(held), None)
        if first is None:
            raise DataError(f"{tree.path}: assay {name} has no layers")
        for k, real in held.items():
            own = tree.attrs(real).get("layer") or {"scale.data": "scaled"}.get(k, k)
            key = "X" if k == first else f"layers/{own}"
            if tree.kind(real) == "array":
                self.put(key, real)
            else:
                kind = "csr_matrix" if tree.array(f"{real}/indptr").shape[0] == n + 1 else "csc_matrix"
                self.group(key, {"encoding-type": kind, "shape": [n, p]})
                for part in ("data", "indices", "indptr"):
                    self.put(f"{key}/{part}", f"{real}/{part}")
        order = lambda key: [c for c in tree.attrs(key).get("colnames", []) if tree.kind(Z.join(key, c))] or [c for c in tree.children(key) if c != "_index"]
        self.frame("obs", {c: f"meta.data/{c}" for c in order("meta.data")}, ("cell.names", None))
        table = next((f"{at}/{t}" for t in ("meta.features", "meta.data") if tree.kind(f"{at}/{t}") == "group"), None)
        self.frame("var", {c: f"{table}/{c}" for c in order(table)} if table else {}, (features, None))
        for r in tree.children("reductions"):
            own = tree.attrs(f"reductions/{r}")
            if tree.kind(f"reductions/{r}/cell.embeddings") == "array":
                self.put(f"obsm/{own.get('obsm', f'X_{r}')}", f"reductions/{r}/cell.embeddings")
            if tree.kind(f"reductions/{r}/feature.loadings") == "array":
                self.put(f"varm/{own.get('varm', M.LOADINGS_OUT.get(r, r.upper()))}", f"reductions/{r}/feature.loadings")
        for top, place, size in (("obsp", "graphs", n), ("varp", f"{at}/misc/varp", p)):
            for g in tree.children(place):
                key = f"{top}/{tree.attrs(f'{place}/{g}').get('key', g)}"
                self.group(key, {"encoding-type": "csr_matrix", "shape": [size, size]})
                for part in ("data", "indices", "indptr"):
                    self.put(f"{key}/{part}", f"{place}/{g}/{part}")
        if tree.kind("misc") == "group":
            self.link("uns", "misc")

    def _matrix(self, key: str) -> bool:
        return self.tree.kind(key) == "array" and len(self.tree.array(key).shape) == 2 or self.tree.kind(f"{key}/indptr") == "array"


class LoomView(View):
    """A Loom file, 0.1 or 3.0: a dense matrix of genes x cells, attributes as columns or embeddings, graphs as edges."""

    def __init__(self, tree, genes: str = "Gene", cells: str = "CellID"):
        super().__init__(tree)
        if tree.kind("matrix") != "array" or len(tree.array("matrix").shape) != 2:
            raise DataError(f"{tree.path} has no matrix")
        p, n = tree.array("matrix").shape
        version = str(tree.attrs("").get("LOOM_SPEC_VERSION") or (tree.array("attrs/LOOM_SPEC_VERSION").read().reshape(-1)[0] if tree.kind("attrs/LOOM_SPEC_VERSION") == "array" else "0.1.0"))
        self.nodes[""] = ("group", None, {"format": "loom", "version": version})
        self.put("X", "matrix", {"transposed": True})
        for name in tree.children("layers"):
            if tree.array(f"layers/{name}").shape != [p, n]:
                raise DataError(f"layer {name} has another shape than the matrix")
            self.put(f"layers/{name}", f"layers/{name}", {"transposed": True})
        for top, file, size, name, stem in (("obs", "col_attrs", n, cells, "Cell"), ("var", "row_attrs", p, genes, "Gene")):
            columns: dict[str, str] = {}
            first = [k for k in tree.attrs(file).get("colnames", []) if tree.kind(f"{file}/{k}") == "array"]
            for k in [*first, *[k for k in tree.children(file) if k not in first]]:
                if tree.kind(f"{file}/{k}") == "array" and tree.array(f"{file}/{k}").shape[:1] == [size]:
                    if len(tree.array(f"{file}/{k}").shape) == 2:
                        self.put(f"{top}m/{k}", f"{file}/{k}")
                    else:
                        columns[k] = f"{file}/{k}"
            index = columns.pop(name, None)
            self.frame(top, columns, (index, None) if index else (Names(stem, size), None))
            for g in tree.children(file.replace("attrs", "graphs")):
                real = f"{file.replace('attrs', 'graphs')}/{g}"
                self.group(f"{top}p/{g}", {"encoding-type": "coo", "shape": [size, size]})
                for part, stored in (("row", "a"), ("col", "b"), ("data", "w")):
                    self.put(f"{top}p/{g}/{part}", f"{real}/{stored}")
        if tree.kind("attrs/uns") == "group":
            self.link("uns", "attrs/uns")

    def levels(self) -> list[tuple[str, str, int, str, bool]]:
        """Loom has no factors: their levels stand in the file's attributes."""
        out = []
        for top in ("obs", "var"):
            for col in self.tree.children(f"attrs/levels/{top}"):
                key = f"attrs/levels/{top}/{col}"
                out += [(top, col, k, str(v), bool(self.tree.attrs(key).get("ordered", False))) for k, v in enumerate(self.tree.array(key).read().tolist())]
        return out


VIEWS = {"h5seurat": SeuratView, "loom": LoomView}
