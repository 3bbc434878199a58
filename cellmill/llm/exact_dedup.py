"""Exact document dedup by content sort.

Sampled splitters range-partition the normalised text, an external sort puts equal texts next to each other, and a
window over the sorted run compares neighbours in full and keeps the smallest identifier. DataFrame operations only.

Splitters go through the driver, so they are sampled from a short order-preserving key: the first HEAD characters, then a
hash. Texts that begin alike are ordered by that hash before they are compared in full, and equal texts stay adjacent.

A text of many rows, or of many bytes in all rows, would land in one range. A first pass counts hashes map-side and finds
those of more than HOT_ROWS rows or HOT_BYTES bytes, limits that do not depend on the size of the table. Their rows are
sorted apart from the others with a salt as last sort key, so splitters fall inside a group; what each salted run found
(the text, its smallest identifier and number of rows) is compared in full again and merged.

Defined results: a null text is the empty text; a null identifier sorts last; among rows with one identifier and equal
texts, one stays; texts of any length are compared whole; an empty table gives an empty result; an input column named
like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import bounded
from .shared import materialise, without

#: A hash with more rows than this, or with as many bytes in more than one row, is salted.
HOT_ROWS, HOT_BYTES = 1024, 64 << 20
#: Characters of a text in the range key, and salts of a hot text.
HEAD, SALTS = 32, 1024
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")
_ID, _NORM, _SALT, _RUN, _HEAD, _HASH = "__xd_id", "__xd_norm", "__xd_salt", "__xd_run", "__xd_head", "__xd_hash"


def normalised(text):
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in ranges of keys, with the place in its run of equal texts, and the run's smallest identifier and size."""
    same = Window.partitionBy(*keys, _NORM)
    return (
        rows.repartitionByRange(*[F.col(k) for k in keys])
        .withColumn(_RUN, F.row_number().over(same.orderBy(F.col(_ID).asc_nulls_last())))
        .withColumn("keep_id", F.min(_ID).over(same))
        .withColumn("group_size", F.count("*").over(same))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256."""
    text = normalised(F.col(text_col))
    base = without(docs, *OUTPUT).withColumns({_NORM: text, _ID: F.col(id_col)}).withColumns({_HEAD: F.substring(_NORM, 1, HEAD), _HASH: F.xxhash64(_NORM)})
    sizes = docs.select(F.xxhash64(text).alias("h"), F.octet_length(text).alias("b")).groupBy("h").agg(F.count("*").alias("n"), F.max("b").cast("long").alias("b"))
    hot = materialise(sizes.filter((F.col("n") > HOT_ROWS) | ((F.col("n") > 1) & (F.col("n") * F.col("b") > HOT_BYTES))).select(F.col("h").alias("__xd_hot")))
    if hot.isEmpty():
        out = _sorted(base, _HEAD, _HASH)
    else:
        marked = base.join(bounded(hot), F.col(_HASH) == F.col("__xd_hot"), "left")
        cold = _sorted(marked.filter("__xd_hot is null").drop("__xd_hot"), _HEAD, _HASH)
        salted = marked.filter("__xd_hot is not null").drop("__xd_hot").withColumn(_SALT, F.pmod(F.xxhash64(_ID), F.lit(SALTS)))
        runs = _sorted(salted.select(_ID, _NORM, _HEAD, _HASH, _SALT), _HEAD, _HASH, _SALT).filter(F.col(_RUN) == 1)
        # at most SALTS rows a hot text; what is handed back is a digest and two numbers for each
        whole = runs.groupBy(_HASH, _NORM).agg(F.min("keep_id").alias("__xd_k"), F.sum("group_size").alias("__xd_s"))
        whole = materialise(whole.select(F.sha2(_NORM, 256).alias("__xd_h"), "__xd_k", "__xd_s"))
        warm = _sorted(salted, _HEAD, _HASH, _SALT).join(bounded(whole), F.sha2(_NORM, 256) == F.col("__xd_h"))
        warm = warm.withColumns({"keep_id": F.col("__xd_k"), "group_size": F.col("__xd_s")}).drop(_SALT, "__xd_h", "__xd_k", "__xd_s")
        out = cold.unionByName(warm)
    # a salt is a hash of the identifier, so rows of one identifier are in one run
    out = out.withColumns({"kept": (F.col(_RUN) == 1) & F.col(_ID).eqNullSafe(F.col("keep_id")), "text_sha256": F.sha2(_NORM, 256)})
    return out.drop(_NORM, _RUN, _ID, _HEAD, _HASH)
