"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed byte trigrams, hashed words, and repeats: a word that stands again right after itself gives the
term of how often it did so far, by doublings. Their log-scaled, rarity-weighted, centred counts are projected to DIMS dimensions by a truncated SVD of the labelled rows. The labelled
vectors are broadcast (at most FIT_ROWS of DIMS numbers); every document's cosine with all of them is computed exactly,
block by block, and its K nearest vote, weighted by similarity.

Fitting takes at most FIT_ROWS labelled rows, those with the smallest hash of their identifier; that is the only bound,
and every row is scored on its whole text. Labels, language, source and identifier are no inputs of a score. Models are
trained here, on the driver, from numpy alone; a fixed seed makes them repeatable.

Defined results: a null or empty text, or one whose vector is zero, gets the labelled rows' mean; without labelled rows
each score is 1 (nothing is known against a text); of neighbours that are as near, any may be left out of the K; repeated
rows each keep their row; texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import without
from .textkit import SPACED, mix, texts_in_chunks, word_hashes

FIT_ROWS, DIMS, K, FOLDS, THRESHOLD = 4000, 48, 8, 5, 0.3
HASHED, RUNS = 1024, 24
TERMS = 2 * HASHED + RUNS
OUTPUT = ("held_out", "score", "predicted")
_U = np.uint64


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts per text, scaled to texts of 300 terms."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for first, end, data, offsets in texts_in_chunks(texts):
        x = data.astype(np.uint64)
        grams = (mix((x[:-2] << _U(16)) | (x[1:-1] << _U(8)) | x[2:]) % _U(HASHED)).astype(np.int64) if len(x) > 2 else np.zeros(0, np.int64)
        words, at = word_hashes(data, offsets, SPACED)
        hashed = (words % _U(HASHED)).astype(np.int64)
        for k in range(first, end):
            i = k - first
            row, own = out[k], words[at[i] : at[i + 1]]
            row[:HASHED] = np.bincount(grams[offsets[i] : max(offsets[i], offsets[i + 1] - 2)], minlength=HASHED)
            row[HASHED : 2 * HASHED] = np.bincount(hashed[at[i] : at[i + 1]], minlength=HASHED)
            same = own[1:] == own[:-1]
            if same.any():
                place = np.arange(len(same))
                length = place - np.maximum.accumulate(np.where(same, -1, place))
                row[2 * HASHED :] = np.bincount(np.log2(length[same]).astype(np.int64), minlength=RUNS)[:RUNS]
    total = out.sum(axis=1, keepdims=True)
    return np.log1p(out * (300 / np.maximum(total, 1)))


class Model:
    def __init__(self, texts: list[str | None], labels: list[int]):
        self.labels = np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 1.0
        if not len(labels):
            return
        counts = term_counts(texts)
        self.rarity = np.log(1 / ((counts > 0).mean(axis=0) + 1e-3)).astype(np.float32)
        weighted = self._unit(counts * self.rarity)
        self.mean = weighted.mean(axis=0)
        weighted -= self.mean
        # truncated SVD by subspace iteration
        basis = np.random.default_rng(8).standard_normal((TERMS, DIMS), dtype=np.float32)
        for _ in range(8):
            basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
        self.axes = np.ascontiguousarray(basis, np.float32)
        self.vectors = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)

    def scores(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(K, len(self.labels))
        for at in range(0, len(texts), block):
            counts = term_counts(texts[at : at + block])
            some = counts.any(axis=1)
            near = self._unit((self._unit(counts * self.rarity) - self.mean) @ self.axes) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64)
            total = weight.sum(axis=1)
            vote = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + block] = np.where(some & (total > 0), vote, self.prior)
        return out


def held_out(ident: Column) -> Column:
    """Rows that are never learned from: crc32 of the identifier as text, modulo FOLDS, is 0 (null: false)."""
    return F.coalesce(F.crc32(ident.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows outside the held-out fold, of at most ``rows`` of them."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # at most ``rows`` rows
    got = own.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy("id").collect()
    return Model([r.text for r in got], [r.y for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with held_out, score (0 to 1) and predicted (1 if score >= threshold, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for part in parts:
            yield pd.Series(np.round(model.scores(part.tolist()), 6))

    out = without(docs, *OUTPUT).withColumns({"held_out": held_out(F.col(id_col)), "score": score(F.col(text_col))})
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
