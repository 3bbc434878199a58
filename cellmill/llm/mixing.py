"""Mixing sources to target weights: temperature mixing with budgeted block permutations. DataFrame operations only.

Source i with T_i of all tokens, a share of p_i, gets the weight q_i = p_i**a / sum(p**a). The exponent a (one over the
temperature) is bisected on a grid of 1 / STEPS: the smallest a at which no source is repeated more than ``repetition``
times, or the largest a at which the entropy of q is at least ``entropy``; a is between 0 (uniform) and 1 (as found).

Without a ``budget`` (in tokens) the smallest one is taken that uses every document at least once. Source i is then read
e_i = budget * q_i / T_i times: floor(e_i) whole passes and the first documents of a permutation, up to the rest of its
budget. The permutation orders documents by a hash, in blocks of about BLOCK_TOKENS; sums over blocks, then over groups
of blocks, find the block in which the budget ends, and only that block is summed document by document. So no window
holds a source, and documents themselves are not shuffled: their copies follow from the cut of their source.

Each pass permutes blocks (block_order) and documents (doc_order) anew; sort by these two for the training order.

Defined results: a null source is a source; a null text has no tokens; documents of a source without tokens are read
once; rows that repeat an identifier in a source are taken together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import bounded
from .shared import materialise, without

STEPS, BLOCK_TOKENS, GROUP, SALTS = 4096, 1 << 20, 1024, 16
OUTPUT = ("tokens", "epoch", "block_order", "doc_order")


def byte_tokens(text: Column) -> Column:
    """About four bytes a token."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def hash60(*parts: Column) -> Column:
    """60 bits of an md5 over parts, joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _block(h: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftright(h, 30) * blocks, 30)


def exponent(sources: DataFrame, repetition: float | None, entropy: float | None, budget: float | None) -> float:
    """Bisects the exponent over the table of sources (p: share); each round is one aggregate over it."""
    ends = sources.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum("total").alias("all")).first()
    if ends.low is None:
        return 1.0

    def holds(step: int) -> bool:
        a = step / STEPS
        s = sources.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias("l")).first()
        if entropy is not None:
            return math.log(s.z) - a * s.l / s.z < entropy
        times = (ends.high / ends.low) ** (1 - a) if budget is None else budget / ends["all"] * ends.low ** (a - 1) / s.z
        return times <= repetition

    low, high = 0, STEPS  # the first step that holds
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    if entropy is not None and holds(low):  # that is the first step below the target entropy
        low = max(0, low - 1)
    return low / STEPS


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repetition: float = 2.0, entropy: float | None = None, budget: float | None = None, seed: int = 1) -> DataFrame:
    """Each copy of each row of docs with tokens, epoch, block_order and doc_order."""
    order = hash60(F.lit(seed), F.col(id_col))
    slim = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), byte_tokens(F.col(text_col)).alias("tokens"), order.alias("h")))
    totals = slim.groupBy("source").agg(F.sum("tokens").alias("total"))
    whole = totals.agg(F.sum("total").alias("t")).first().t or 1
    totals = materialise(totals.withColumn("p", F.col("total") / F.lit(whole)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_TOKENS)).cast("long")))
    some = totals.filter("total > 0")
    a = exponent(some, repetition, entropy, budget)
    sums = some.agg(F.max("p").alias("high"), F.sum(F.pow("p", F.lit(a))).alias("z")).first()
    if sums.high is None:
        times = F.lit(1.0)
    elif budget is None:
        times = F.pow(F.lit(sums.high) / F.col("p"), F.lit(1 - a))
    else:
        times = F.lit(budget / sums.z) * F.pow("p", F.lit(a)) / F.col("total")
    totals = totals.withColumn("times", F.when(F.col("total") > 0, times).otherwise(1.0)).withColumn("passes", F.floor("times").cast("long"))
    totals = materialise(totals.withColumn("rest", (F.col("times") - F.col("passes")) * F.col("total")))

    # where each source's permutation is cut: groups of blocks, then blocks, then the documents of one block
    of = _join_sources(slim, totals)
    blocks = materialise(of.groupBy("source", _block(F.col("h"), F.col("blocks")).alias("block")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")))
    groups = blocks.groupBy("source", F.floor(F.col("block") / GROUP).alias("g")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = lambda by, key: F.sum("tokens").over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    at_group = groups.withColumn("start", F.coalesce(before(["source"], "g"), F.lit(0))).filter("start < rest and start + tokens >= rest").select(F.col("source").alias("s"), F.col("g").alias("at_g"), "start")
    inner = blocks.withColumn("g", F.floor(F.col("block") / GROUP)).join(at_group, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("at_g")))
    at_block = inner.withColumn("begin", F.col("start") + F.coalesce(before(["source"], "block"), F.lit(0))).filter("begin < rest and begin + tokens >= rest")
    at_block = materialise(at_block.select(F.col("s"), F.col("block").alias("at"), "begin", "rest"))
    edge = of.drop("rest").join(bounded(at_block), F.col("source").eqNullSafe(F.col("s")) & (_block(F.col("h"), F.col("blocks")) == F.col("at")))
    running = F.coalesce(F.sum("tokens").over(Window.partitionBy("s").orderBy("h", F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = edge.withColumn("begin", F.col("begin") + running).filter("begin < rest").groupBy("s").agg(F.max(F.struct("h", "id")).alias("cut"))
    totals = totals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "blocks", "passes", "cut")
    totals = materialise(totals)

    base = without(docs, *OUTPUT)
    named = totals.withColumnsRenamed({c: f"__mix_{c}" for c in totals.columns})
    own = _join_sources(base.withColumns({"__mix_h": order}), named, source_col, "__mix_source")
    taken = F.coalesce((F.struct(F.col("__mix_h").alias("h"), F.col(id_col).alias("id")) <= F.col("__mix_cut")).cast("long"), F.lit(0).cast("long"))
    copies = F.col("__mix_passes") + taken
    out = own.filter(copies > 0).withColumns({"tokens": byte_tokens(F.col(text_col)), "epoch": F.explode(F.sequence(F.lit(1).cast("long"), copies))})
    out = out.withColumns({"block_order": hash60(F.lit(seed), F.col(source_col), _block(F.col("__mix_h"), F.col("__mix_blocks")), F.col("epoch")), "doc_order": hash60(F.lit(seed), F.col(id_col), F.col("epoch"))})
    return out.drop("__mix_h", "__mix_source", "__mix_blocks", "__mix_passes", "__mix_cut", "__mix_salt")


def _join_sources(rows: DataFrame, sources: DataFrame, left: str = "source", right: str = "__src") -> DataFrame:
    """rows with what sources has of their source: a broadcast while the table of sources is counted to be small, else
    a join salted on both sides, so that a source of a third of the rows is spread."""
    if left == "source" and right == "__src":
        sources = sources.withColumnRenamed("source", right)
    hinted = bounded(sources)
    same = F.col(left).eqNullSafe(F.col(right))
    if hinted is not sources:
        return rows.join(hinted, same, "left").drop(*([right] if right == "__src" else []))
    salted = sources.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__mix_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c in ("h", "__mix_h")]), F.lit(SALTS)).cast("int"))
    out = rows.join(salted, same & (F.col("__mix_salt") == F.col("__mix_copy")), "left").drop("__mix_copy", "__mix_salt")
    return out.drop(right) if right == "__src" else out
