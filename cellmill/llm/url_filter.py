"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

entries: host, path, verdict, named, exact. A named entry is a rule: it fits its host and all subdomains where the URL's
path starts with the rule's path, both as they stand. Other entries are listed and compared in canonical form: with exact
set they are whole URLs, else they fit like rules.

**Canonical form.** Of the host: A-Z in lower case, without user, port 80 or 443, and dots at the end. Of the path: runs
of slashes are one, an empty one is ``/``. Query and fragment do not count.

The entries' forms are few (label counts of hosts, lengths of paths), so a URL has a bounded number of candidate keys. Each
is probed in a split-block Bloom filter (eight 64-bit words a block, one bit in each), built by ``bit_or`` over the list.
The filter has 16 bits for a key and MAX_BLOCKS blocks at most (64 bytes each), so it is always broadcast and keys are
probed where they are made; a list beyond that only has more false positives. Keys that pass go to the exact join, which
removes these; of the entries that are left the longest rule wins, else the longest listed one. DataFrame operations only.

Defined results: null or no ``://`` gives empty host and path, no rule and the default verdict; an empty list lets all
through; repeated and null rows of pages each keep their row; of equal entries with different verdicts, block wins; of an
exact and another entry of one length, the exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import bounded
from .shared import ascii_lower, materialise, without

BITS_A_KEY, MAX_BLOCKS = 16, 1 << 18
OUTPUT = ("host", "path", "rule", "verdict")
#: Odd multipliers that pick the bit in each word of a block.
ODD = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"[.]*(:(80|443)?)?$", "")


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(F.when(path == "", "/").otherwise(path), "/+", "/")


def _key(kind: str | Column, host: Column, path: Column) -> Column:
    """kind: r for rules, l for listed ones, x for listed whole URLs."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """The bit that a key sets in word number word of its block."""
    low = F.xxhash64(key, F.lit("bit")).bitwiseAND(F.lit(0x7FFFFFFF))  # so that the product fits
    bit = F.shiftrightunsigned((low * F.lit(ODD[word])).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the blocked filter of entries' keys; at most ``blocks`` rows."""
    masks = entries.select(_block(F.col("key"), blocks).alias("block"), *[_mask(F.col("key"), i).alias(f"w{i}") for i in range(8)])
    return masks.groupBy("block").agg(F.array(*[F.bit_or(f"w{i}") for i in range(8)]).alias("words"))


def _fitting(host: Column, path: Column, labels: list[int], lengths: list[int], kind: str) -> list[Column]:
    """Keys of the entries of these forms that would fit."""
    parts = F.split(host, r"\.")
    suffixes = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - (k - 1), k), ".")) for k in labels]
    prefixes = [F.when(F.length(path) >= m, F.substring(path, 1, m)) for m in lengths]
    return [_key(kind, s, p) for s in suffixes for p in prefixes]


def url_filter(pages: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of pages with host, path, rule and verdict. entries: host, path, verdict, named (a rule: it goes before
    what is only listed and is named in the result), exact (a whole URL; without this column none is)."""
    given = entries.filter("host is not null and path is not null")
    if "exact" not in given.columns:
        given = given.withColumn("exact", F.lit(False))
    named, exact = F.col("named"), F.col("exact") & ~F.col("named")
    host, path = ascii_lower(F.col("host")), F.col("path")
    given = given.select(F.when(named, host).otherwise(canonical_host(host)).alias("host"), F.when(named, path).when(exact, canonical_path(path)).otherwise(F.regexp_replace(path, "/+", "/")).alias("path"), "verdict", "named", exact.alias("exact"))
    kind = F.when(F.col("named"), "r").when(F.col("exact"), "x").otherwise("l")
    entries = materialise(given.groupBy(kind.alias("kind"), "host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", _key(F.col("kind"), F.col("host"), F.col("path"))))
    forms = {r.kind: r for r in entries.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.when(F.col("kind") != "x", F.length("path")))).alias("lengths")).collect()}  # three rows
    base = without(pages, *OUTPUT).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not forms:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = min(MAX_BLOCKS, max(1, -(-sum(r.n for r in forms.values()) * BITS_A_KEY // 512)))
    filled = F.broadcast(materialise(bloom_blocks(entries, blocks)))  # MAX_BLOCKS rows of 64 bytes at most

    own, other = (F.col("host"), F.col("path")), (canonical_host(F.col("host")), canonical_path(F.col("path")))
    keys = [k for name, at in (("r", own), ("l", other)) if name in forms for k in _fitting(*at, forms[name].labels, forms[name].lengths, name)]
    keys += [_key("x", *other)] if "x" in forms else []
    urls = base.select("host", "path").filter("host <> ''").distinct().withColumn("key", F.explode(F.array_compact(F.array(*keys))))
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.element_at("words", i + 1).bitwiseAND(_mask(F.col("key"), i)) != 0)
    passed = urls.withColumn("block", _block(F.col("key"), blocks)).join(filled, "block").filter(hit).select("host", "path", "key")
    listed = entries.select("key", F.concat("host", "path").alias("rule"), "verdict", (F.col("kind") == "r").alias("named"), (F.col("kind") == "x").alias("exact"))
    found = passed.join(bounded(listed), "key")
    best = found.groupBy("host", "path").agg(F.max(F.struct("named", F.length("rule").alias("size"), "exact", "rule", "verdict")).alias("best"))
    # no bound is known for the distinct URLs, so they are never broadcast; a hot URL is split by adaptive execution
    best = materialise(best.select("host", "path", F.when(F.col("best.named"), F.col("best.rule")).alias("rule"), "best.verdict"))
    return base.join(best.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
