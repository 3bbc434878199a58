"""Connected components over an edge table: distributed minimum hooking with contraction.

Each round hooks every node to its smallest neighbour, shortens the paths to the roots and replaces the edges by those
between different roots. So an edge is joined once in a round and seldom outlives the first one, and a node with an edge
is in a tree of two or more after two rounds: there are 2 log2(n) at most. Tables of a round are written to the shared
folder, so lineage stays short and both sides of each join have exchanges of their own (adaptive execution splits a
hub's rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, materialise

#: Identifiers and keys (16 bytes or less each) that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000
PIVOT_ROUNDS = 1
#: Members of a bucket up to which its queries are paired with its members.
DIRECT = 16
#: Hashes of the queries that a task holds, and of the rows that it compares with them.
BLOCK, PART = 1_000_000, 20_000_000


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of keys, if it has at most BROADCAST_IDS rows; else df as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns node, component (the smallest node reachable); nodes without edges
    are not in it."""
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not (rounds and left.isEmpty()):
        ends = left.select(F.col("a").alias("node"), "b").union(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
        trees = ends.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
        trees = materialise(trees.withColumn("moved", F.col("root") != F.col("node")))
        while not trees.filter("moved").isEmpty():  # what a jump doesn't move has reached its root
            jump = trees.select(F.col("node").alias("root"), F.col("root").alias("far"))
            after = trees.filter("moved").select("node", "root").join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
            after = materialise(after.union(trees.filter("not moved")))
            free(trees)
            trees = after
        rounds.append(trees)
        over = left.join(trees.select(F.col("node").alias("b"), F.col("root").alias("q")), "b").join(trees.select(F.col("node").alias("a"), F.col("root").alias("p")), "a")
        over = materialise(over.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        free(left)
        left = over
    free(left)
    labels = rounds.pop()
    while rounds:  # a root of one round is a node of the next one, if it has edges there
        own = rounds.pop()
        later = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = materialise(own.join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
        free(own, labels)
        labels = out
    return labels.select("node", F.col("root").alias("component"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(right, "b").join(left, "a").filter(both * 100 >= (F.size("x") + F.size("y") - both) * percent)
    return near.select("a", "b")


def similar_size(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def links(members: DataFrame, sets: DataFrame, percent: int, confirm: Callable[[DataFrame, DataFrame, int], DataFrame] = confirmed, hashes: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Confirmed links (a, b) between classes that connect whatever the pairs of one bucket connect.

    members: band, key, n (size of the class's set). sets: key, hashes (the distinct hashes of a class's shingles), or
    what ``confirm`` and ``hashes`` (which makes these two columns) read instead.

    In each of PIVOT_ROUNDS rounds a bucket names one pivot, and its members outside the pivot's component are compared
    with it, which is linear in the bucket; pairs inside a component need no test. What buckets are left with several
    components go to leftover(). So no link between components is lost and no bucket is capped."""
    found = members.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    labels, tested = None, found
    for turn in range(PIVOT_ROUNDS + 1):
        at = members.withColumn("component", F.col("key")) if labels is None else members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        at = materialise(at)
        if turn < PIVOT_ROUNDS:
            rank = F.xxhash64("key", F.lit(turn))  # the same in each band: buckets of one group share few pivots, so a member meets few
            pivots = at.groupBy("band").agg(F.min_by(F.struct("key", "component", "n"), F.struct(rank, "key")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
            pivots = materialise(pivots.select("band", F.col("p.key").alias("a"), F.col("p.component").alias("of"), F.col("p.n").alias("m")))
            pairs = at.join(pivots, "band").filter((F.col("component") != F.col("of")) & similar_size("n", "m", percent)).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))
        else:
            return found.union(leftover(at, sets, tested, percent, confirm, hashes))
        pairs = materialise(pairs.distinct())
        tested = tested.union(pairs) if turn else pairs
        new = materialise(confirm(pairs, sets, percent))
        found = found.union(new) if turn else new
        labels = components(found)
    return found


def leftover(at: DataFrame, sets: DataFrame, tested: DataFrame, percent: int, confirm: Callable[[DataFrame, DataFrame, int], DataFrame], hashes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between different components in buckets that have several: members outside a bucket's largest component are
    the queries. In buckets of up to DIRECT members they are paired with the others; larger buckets go to block_links().

    at: band, key, n, component. hashes: rows of sets -> key, hashes."""
    parts = at.groupBy("band", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("parts"))
    open_ = materialise(at.join(main.filter("parts > 1").drop("parts"), "band"))
    few = open_.filter(F.col("size") <= DIRECT)
    rest = few.filter("component <> main").select("band", F.col("key").alias("b"), F.col("component").alias("of"), F.col("n").alias("m"))
    pairs = few.join(rest, "band").filter((F.col("component") != F.col("of")) & similar_size("n", "m", percent)).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
    large = open_.filter(F.col("size") > DIRECT)
    if not large.isEmpty():
        # buckets that share members are one family, so that a pair of many buckets is compared once
        hubs = large.join(large.groupBy("band").agg(F.min("key").alias("hub")), "band").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
        asks = large.groupBy("key").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("asks"))
        rows = asks.join(components(hubs).withColumnsRenamed({"node": "key", "component": "family"}), "key")
        rows = materialise(hashes(sets.join(rows.select("key"), "key", "left_semi")).join(rows, "key"))
        pairs = pairs.union(block_links(rows, percent))
    pairs = materialise(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
    return materialise(confirm(pairs, sets, percent))


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of a family of which one asks, with 100 * intersection >= percent * union of
    their hashes. rows: family, key, component, asks, hashes.

    Queries of a family come in blocks of about BLOCK hashes, its rows in chunks of about PART hashes; each task meets
    one block, as an inverted index, and streams one chunk past it. So no pair is made but links, a task holds one block
    whatever the size of the family, and a large family is split."""
    size = F.size("hashes").cast("long")
    work = rows.groupBy("family").agg(F.sum(F.when(F.col("asks"), size).otherwise(0)).alias("q"), F.sum(size).alias("t")).filter("q > 0")
    work = work.select("family", F.ceil(F.col("q") / BLOCK).cast("long").alias("blocks"), F.ceil(F.col("t") / PART).cast("long").alias("chunks"))
    rows = rows.join(work, "family")
    of = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = rows.filter("asks").select("family", of("blocks", 1).alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("kind"), "key", "component", "hashes")
    others = rows.select("family", each("blocks").alias("block"), of("chunks", 2).alias("chunk"), F.lit(1).alias("kind"), "key", "component", "hashes")
    met = queries.union(others).repartition("family", "block", "chunk").sortWithinPartitions("family", "block", "chunk", "kind")

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, labels, held, index = None, [], [], [], None
        for part in parts:
            a, b = [], []
            names = list(zip(*[part.column(k).to_pylist() for k in range(6)], strict=True))
            for row, (family, block, chunk, kind, key, component) in enumerate(names):
                if (family, block, chunk) != group:
                    group, keys, labels, held, index = (family, block, chunk), [], [], [], None
                own = part.column(6)[row].values.to_numpy()
                if kind == 0:
                    keys.append(key)
                    labels.append(component)
                    held.append(own.copy())
                    continue
                if index is None:
                    tokens = np.concatenate(held) if held else np.zeros(0, np.int64)
                    order = np.argsort(tokens, kind="stable")
                    owners = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])[order]
                    unique, starts = np.unique(tokens[order], return_index=True)
                    index, sizes, held = (unique, np.append(starts, len(tokens)), owners), np.array([len(h) for h in held]), []
                unique, starts, owners = index
                if not len(unique):
                    continue
                at = np.minimum(np.searchsorted(unique, own), len(unique) - 1)
                at = at[unique[at] == own]
                if not len(at):
                    continue
                both = np.bincount(np.concatenate([owners[starts[i] : starts[i + 1]] for i in at]), minlength=len(keys))
                for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)):
                    if labels[k] != component:
                        a.append(min(key, keys[k]))
                        b.append(max(key, keys[k]))
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return met.mapInArrow(probe, "a binary, b binary").distinct()
