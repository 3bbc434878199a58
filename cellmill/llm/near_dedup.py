"""MinHash near-dedup: fast similarity sketching, banding, exact verification, components.

**Sketch.** Rounds of hashed bin placement: in round r of the first BINS rounds each shingle falls into a hashed bin with
value r + u, 0 <= u < 1; in the next BINS rounds every shingle falls into bin r - BINS. A bin keeps its smallest value. All
bins are filled after 2 * BINS rounds at the latest, after few rounds for most sets, and equal bins estimate the Jaccard
similarity with concentration like that of independent hashes.

**Banding.** BINS = BANDS * ROWS. A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.

**Verification.** Rows with one shingle set are one class, represented by its smallest identifier, so copies take part
once. The sets of classes that share a band with another are kept in a table; a link is confirmed on the full sets.

**Buckets of any size** are linked without a cap, see components.links().

Defined results: null or empty texts have an empty set and stand alone; fewer than SHINGLE words are one shingle; repeated
rows are one class and have one verdict; an identifier that stands with several texts has a verdict for each; a null
identifier is the largest; texts of any length take part whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import bounded, components, links
from .shared import free, materialise
from .textkit import SPACED, mix, runs_of, texts_in_chunks, word_hashes

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for _, _, data, offsets in texts_in_chunks(texts):
        words, at = word_hashes(data, offsets, SPACED)
        runs = runs_of(words, size)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield runs_of(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS values of a set that isn't empty; equal values in a bin mean one shingle won it in both sets."""
    best = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, min(2 * BINS, 2 * BINS // max(1, len(shingles))))
    for at in range(0, 2 * BINS, step):
        rounds = np.arange(at, min(at + step, 2 * BINS))
        h = mix(shingles[None, :] ^ _SEEDS[rounds][:, None])
        fixed = rounds >= BINS
        bins = ((h >> _U(32)) % _U(BINS)).astype(np.int64)
        bins[fixed] = (rounds[fixed] - BINS)[:, None]
        values = (rounds.astype(np.uint64) << _U(50))[:, None] | (h & _U((1 << 50) - 1))
        np.minimum.at(best, bins.ravel(), values.ravel())
        if best.max() != np.iinfo(np.uint64).max:
            break
    return best


_BAND = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))
_POWER = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(ROWS)], dtype=np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch; the band's number is part of it."""
    return mix((mix(values).reshape(BANDS, ROWS) * _POWER).sum(axis=1, dtype=np.uint64) ^ _BAND)


def _profiles(size: int):
    import xxhash

    def profile(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1)
            for at in range(0, len(texts), 512):
                n, keys, bands = [], [], []
                for s in shingle_sets(texts.slice(at, 512).to_pylist(), size):
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(band_keys(sketch(s)).view(np.int64).tolist() if len(s) else None)
                yield pa.record_batch([part.column(0).slice(at, 512), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "key", "bands"])

    return profile


def _sets(size: int):
    import xxhash

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                made = list(shingle_sets(own.column(1).to_pylist(), size))
                keys = [xxhash.xxh3_128_digest(m.tobytes()) if len(m) else None for m in made]
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([m.view(np.int64) for m in made], pa.list_(pa.int64()))], ["key", "hashes"])

    return make


def _verdicts(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rows: id, text. One row each: id, n, key (of its shingle set; null if empty), component_id, kept."""
    kind = rows.schema["id"].dataType.simpleString()
    profiles = materialise(rows.mapInArrow(_profiles(shingle), f"id {kind}, n long, key binary, bands array<long>"))
    reps = materialise(profiles.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = reps.select("key", "rep", "n", F.explode("bands").alias("band"))
    shared_bands = materialise(spread.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"))
    members = materialise(spread.join(bounded(shared_bands), "band"))

    chosen = materialise(members.select(F.col("rep").alias("__id")).distinct())
    texts = rows.join(bounded(chosen), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    sets = materialise(texts.mapInArrow(_sets(shingle), "key binary, hashes array<long>").filter("key is not null").groupBy("key").agg(F.first("hashes").alias("hashes")))
    found = links(members.select("band", "key", "n"), sets, percent)

    roots = reps.select("key", "rep").join(components(found).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = roots.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first"))  # null is the largest
    of_class = materialise(roots.join(first, "component").select("key", F.col("first.rep").alias("component_id"), (F.col("key") == F.col("first.key")).alias("leads")))
    free(reps, shared_bands, members, chosen, sets)
    out = profiles.select("id", "n", "key").join(of_class, "key", "left")
    alone = F.col("key").isNull()
    kept = alone | (F.col("leads") & F.col("id").eqNullSafe(F.col("component_id")))
    return out.select("id", "n", "key", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: its identifier, n_shingles, component_id (the smallest identifier of the rows
    that are linked with it) and kept (it is that one). Texts are recomputed, not shuffled: only keys move."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _verdicts(rows, shingle, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component keeps another one. An identifier may be repeated or null: each row has the
    verdict of its own text, found again by the key of its shingle set."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = materialise(_verdicts(rows, shingle, percent).filter("not kept").select(F.col("id").alias("__nd_id"), F.col("key").alias("__nd_key")).distinct())
    suspects = materialise(gone.select(F.col("__nd_id").alias("__nd_some"), F.lit(True).alias("__nd_asks")).distinct())
    asked = docs.join(bounded(suspects), F.col(f"`{id_col}`").eqNullSafe(F.col("__nd_some")), "left").drop("__nd_some")
    # only texts of those identifiers are read again
    keyed = asked.withColumn("__nd_own", _key_of(shingle)(F.when(F.col("__nd_asks"), F.col(f"`{text_col}`"))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__nd_id")) & (F.col("__nd_own") == F.col("__nd_key"))
    return keyed.join(bounded(gone), same, "left_anti").drop("__nd_own", "__nd_asks")


def _key_of(size: int):
    import xxhash

    @F.pandas_udf("binary")
    def key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for at in range(0, len(part), 512):
                out += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(part.iloc[at : at + 512].tolist(), size)]
            yield pd.Series(out, dtype=object)

    return key
