"""The training-corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing. Part of cellmill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmill.llm.decontaminate import decontaminate
from cellmill.llm.exact_dedup import exact_dedup
from cellmill.llm.mixing import mix_sources
from cellmill.llm.near_dedup import drop_near
from cellmill.llm.quality import score_quality
from cellmill.llm.queries import REPETITION
from cellmill.llm.shared import free, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return score_quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).filter("kept").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near(docs).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents at the target weights of their sources, with the order to read them in."""
    return mix_sources(docs, repetition=REPETITION)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mix),
]

#: A trained classifier and near copies can't be expressed in SQL; tests/llm/test_pipeline.py goes through rows and pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
