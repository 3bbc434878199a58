"""Benchmark decontamination: prefix-filtered set join with exact verification.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words is one window). A window's set is its
shingles of SHINGLE words, ordered by rarity in the corpus (counted over all documents). Containment asks for all of
them, so the necessary prefix is one shingle, the rarest: a document joins a window only where it has that shingle.
The shingle's place fixes where the window must begin (positional bound) and end (length bound); there the hashes of the
words, then the words themselves are compared. (Windows of a block with one 64-bit hash are taken for equal.)

The index of a block of items, at most ``BLOCK_WORDS`` item words, is a few flat arrays (about 60 bytes a word) in a
broadcast of its own. A task holds about ``HELD`` bytes of texts at a time and takes the blocks one after another, so its
memory is bounded whatever the size of the benchmark, and the corpus is read twice (to count and to probe), however many
blocks there are. Documents are never shuffled or written.

Defined results: null or empty texts have no words and no hits; items without words have no windows; repeated rows each
keep their row; an empty benchmark hits nothing; items with one text count each; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, without
from .textkit import ALNUM, FOLD, placed_hashes, runs_of, texts_in_chunks

WINDOW, SHINGLE, BLOCK_WORDS, HELD = 13, 4, 250_000, 4 << 20
OUTPUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_PLACES = T.ArrayType(T.LongType())


class Words:
    """A text's words: their hashes, and the bytes that they are."""

    def __init__(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.hashes, self.data, self.starts, self.stops = hashes, data, starts, stops

    def joined(self, begin: int, end: int) -> bytes:
        """Folded words, joined by spaces."""
        return b" ".join(FOLD[self.data[a:b]].tobytes() for a, b in zip(self.starts[begin:end].tolist(), self.stops[begin:end].tolist(), strict=True))


def _words(texts: list[str | None]) -> Iterator[Words]:
    for _, _, data, offsets in texts_in_chunks(texts):
        hashes, at, starts, stops = placed_hashes(data, offsets, ALNUM)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield Words(hashes[a:b], data, starts[a:b], stops[a:b])


class Index:
    """Distinct windows of a block of items, under the hash of their rarest shingle."""

    def __init__(self, items: list[tuple[str, Words]], window: int, shingle: int):
        self.names, self.window, self.shingle = [name for name, _ in items], window, shingle
        counts = np.array([len(w.hashes) for _, w in items], np.int64)
        self.ends = np.cumsum(counts)
        self.hashes = np.concatenate([w.hashes for _, w in items])
        whole = [w.joined(0, len(w.hashes)) for _, w in items]
        self.text = b" ".join(whole)
        # a word's place in the text: words are separated by one space, items too
        sizes = np.concatenate([w.stops - w.starts for _, w in items])
        self.at = np.zeros(len(sizes) + 1, np.int64)
        empty = np.repeat(np.cumsum(counts == 0) - (counts == 0), counts)  # items without words still have their space
        np.cumsum(sizes + 1, out=self.at[1:])
        self.at[:-1] += empty
        starts, lengths, keys, owners = [], [], [], []
        for k, n in enumerate(counts.tolist()):
            if not n:
                continue
            size, first = min(window, n), int(self.ends[k]) - n
            own = self.hashes[first : first + n]
            starts.append(np.arange(first, first + n - size + 1))
            lengths.append(np.full(n - size + 1, size, np.int8))
            keys.append(runs_of(own, size))
            owners.append(np.full(n - size + 1, k, np.int32))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        keys, starts, lengths, owners = cat(keys, np.uint64), cat(starts, np.int64), cat(lengths, np.int8), cat(owners, np.int32)
        order = np.lexsort((owners, lengths, keys))
        keys, starts, lengths, owners = keys[order], starts[order], lengths[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1])
        #: One window stands for all that are equal; owned[k] to owned[k + 1] are the items of window k.
        self.starts, self.lengths = starts[new], lengths[new].astype(np.int64)
        number = np.cumsum(new) - 1
        once = np.ones(len(keys), bool)
        once[1:] = new[1:] | (owners[1:] != owners[:-1])
        self.owners = owners[once]
        self.owned = np.searchsorted(number[once], np.arange(len(self.starts) + 1))
        self.sizes = np.unique(np.minimum(shingle, self.lengths)).tolist()

    def _shingles(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose shingles have m words, and a row of shingles for each."""
        rows = np.flatnonzero(np.minimum(self.shingle, self.lengths) == m)
        if not len(rows):
            return rows, np.zeros((0, 1), np.uint64)
        runs = runs_of(self.hashes, m)  # over the ends of items too: those aren't taken
        span = int(self.lengths[rows].max()) - m + 1
        at = self.starts[rows][:, None] + np.arange(span)
        out = runs[np.minimum(at, max(0, len(runs) - 1))]
        return rows, np.where(np.arange(span) < (self.lengths[rows] - m + 1)[:, None], out, out[:, :1])

    def counted(self) -> dict[int, np.ndarray]:
        """For each length of shingles, the sorted shingles to count."""
        return {m: np.unique(self._shingles(m)[1]) for m in self.sizes}

    def order(self, counted: dict[int, np.ndarray], totals: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle (its first one if several are as rare)."""
        self.prefix = {}
        for m in self.sizes:
            rows, own = self._shingles(m)
            often = totals[m][np.searchsorted(counted[m], own)]
            place = np.argmin(often, axis=1)
            keys = own[np.arange(len(rows)), place]
            order = np.argsort(keys, kind="stable")
            self.prefix[m] = (keys[order], rows[order].astype(np.int32), place[order].astype(np.int32))

    def hits(self, words: Words) -> tuple[list[tuple[int, int]], list[str]]:
        """Word spans of all occurrences of windows, and the items whose windows occur."""
        spans, items = [], set()
        for m, (keys, rows, place) in self.prefix.items():
            runs = runs_of(words.hashes, m)
            low = np.searchsorted(keys, runs)
            found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == runs) if len(keys) else []
            for at in found:
                high = int(np.searchsorted(keys, runs[at], "right"))
                for k in range(int(low[at]), high):
                    w, begin = int(rows[k]), int(at) - int(place[k])
                    size, first = int(self.lengths[w]), int(self.starts[w])
                    if begin < 0 or begin + size > len(words.hashes) or not np.array_equal(words.hashes[begin : begin + size], self.hashes[first : first + size]):
                        continue
                    if words.joined(begin, begin + size) == self.text[self.at[first] : self.at[first + size - 1]] + self._last(first + size - 1):
                        spans.append((begin, begin + size))
                        items.update(self.owners[self.owned[w] : self.owned[w + 1]].tolist())
        return spans, [self.names[k] for k in items]

    def _last(self, word: int) -> bytes:
        """The bytes of one word."""
        end = self.text.find(b" ", self.at[word])
        return self.text[self.at[word] : end if end >= 0 else len(self.text)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, Words]]]:
    """Items with their words, in blocks of about BLOCK_WORDS words; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        words = next(_words([row.t]))
        block.append((row.i, words))
        size += len(words.hashes)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _held(parts: Iterator[pa.RecordBatch], place: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, as many as have about HELD bytes of text."""
    held, size = [], 0
    for part in parts:
        for at in range(0, part.num_rows, 512):
            own = part.slice(at, 512)
            text = own.column(place)
            held.append(own)
            size += int(pc.sum(pc.binary_length(text)).as_py() or 0) + 64 * own.num_rows
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


class Shared:
    """Broadcasts of which a process loads one at a time."""

    def __init__(self, sc):
        self.sc, self.all = sc, []

    def add(self, value) -> None:
        self.all.append(self.sc.broadcast(value))

    def each(self) -> Iterator:
        for b in self.all:
            value = b.value
            yield value
            if len(self.all) > 1:
                b.__dict__.pop("_value", None)  # loaded again from the executor's copy when it is needed

    def __getstate__(self) -> dict:
        return {"sc": None, "all": self.all}


def _counts(docs: DataFrame, text_col: str, counted: Shared) -> DataFrame:
    """block, m, place, n: how often the shingle at a place of a block's list stands in all documents; tallied for each
    portion of texts before anything moves."""

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(parts, 0):
            texts = [w for part in held for w in _words(part.column(0).to_pylist())]
            for block, lists in enumerate(counted.each()):
                for m, keys in lists.items():
                    totals = np.zeros(len(keys), np.int64)
                    for words in texts:
                        runs = runs_of(words.hashes, m)
                        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                        np.add.at(totals, at[keys[at] == runs], 1)
                    some = np.flatnonzero(totals)
                    yield pa.record_batch([pa.array(np.full(len(some), block)), pa.array(np.full(len(some), m)), pa.array(some), pa.array(totals[some])], ["block", "m", "place", "n"])

    return docs.select(text_col).mapInArrow(tally, "block long, m long, place long, n long").groupBy("block", "m", "place").agg(F.sum("n").alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and
    share * n_hit >= n_words)."""
    rest = without(docs, *OUTPUT)
    sc = docs.sparkSession.sparkContext
    bare, counted, indexes = [], Shared(sc), Shared(sc)
    for block in blocks_of(benchmark, item_col, item_text):
        index = Index(block, window, shingle)
        if len(index.starts):
            bare.append(sc.broadcast(index))
            counted.add(index.counted())
    if bare:
        totals = materialise(_counts(docs, text_col, counted))
        for k, lists in enumerate(counted.each()):
            found = totals.filter(F.col("block") == k).toArrow()  # a row a shingle of one block
            m_, at, n = (found[c].to_numpy() for c in ("m", "place", "n"))
            index, sums = bare[k].value, {m: np.zeros(len(keys), np.int64) for m, keys in lists.items()}
            for m in sums:
                sums[m][at[m_ == m]] = n[m_ == m]
            index.order(lists, sums)
            indexes.add(index)
            bare[k].destroy()

    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("__dc_spans", _PLACES), T.StructField("__dc_items", T.ArrayType(T.StringType()))])
    place = rest.columns.index(text_col)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(parts, place):
            texts = [list(_words(part.column(place).to_pylist())) for part in held]
            spans, items = [[[] for _ in own] for own in texts], [[[] for _ in own] for own in texts]
            for index in indexes.each():
                for own, s, i in zip(texts, spans, items, strict=True):
                    for k, words in enumerate(own):
                        hit, names = index.hits(words)
                        if hit:
                            s[k] = merged(s[k] + hit)
                            i[k] += names
            for part, own, s, i in zip(held, texts, spans, items, strict=True):
                flat = [[x for pair in pairs for x in pair] or None for pairs in s]
                columns = [*part.columns, pa.array([len(w.hashes) for w in own], pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(names) or None for names in i], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    state = rest.mapInArrow(probe, schema)
    # begins and ends alternate: ends count for, begins against
    hit = F.aggregate(F.transform("__dc_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda n, x: n + x)
    out = state.withColumns({
        "n_hit": F.coalesce(hit, F.lit(0).cast("long")),
        "n_items": F.coalesce(F.size("__dc_items"), F.lit(0)).cast("long"),
        "items_sha256": F.sha2(F.coalesce(F.array_join("__dc_items", ","), F.lit("")), 256),
    }).drop("__dc_spans", "__dc_items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
