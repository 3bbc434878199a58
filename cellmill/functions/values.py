"""Timestamps, versions and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How files write points in time.
TIMESTAMPS = {"plain": "yyyyMMdd'T'HHmmss'Z'", "loom": "yyyyMMdd'T'HHmmss.SSSSSS'Z'"}


def format_time(ts: Column, kind: str = "plain") -> Column:
    """A timestamp (of a session in UTC) as files write it."""
    return F.date_format(ts, TIMESTAMPS[kind])


def parse_time(text: Column, kind: str = "plain") -> Column:
    """null where a text isn't of that form."""
    return F.try_to_timestamp(text, F.lit(TIMESTAMPS[kind]))


def version_key(version: Column) -> Column:
    """Parts of a version as numbers, so that arrays compare as versions do."""
    return F.transform(F.split(version, "[.-]"), lambda x: x.cast("long"))


def closest_version(version: Column, targets: list[str], up: bool = False, inclusive: bool | None = None) -> Column:
    """The largest target that is at most version, or (up) the smallest that is more; null if there is none. inclusive:
    whether an equal one counts, by default only on the way down."""
    inclusive = not up if inclusive is None else inclusive
    entries = F.array(*[F.struct(version_key(F.lit(t)).alias("k"), F.lit(t).alias("v")) for t in targets])
    own = version_key(version)
    fits = (lambda e: (e.k >= own) if inclusive else (e.k > own)) if up else (lambda e: (e.k <= own) if inclusive else (e.k < own))
    found = F.filter(entries, fits)
    return (F.array_min(found) if up else F.array_max(found))["v"]


def store_address(url: Column) -> Column:
    """kind (s3, gs, http), base (https address), bucket and prefix of a store's URL."""
    bare = F.regexp_replace(url, "/+$", "")
    scheme = F.lower(F.regexp_extract(bare, "^(?i)(s3|gs)://", 1))
    rest = F.regexp_replace(bare, "^(?i)(s3|gs)://", "")
    bucket, prefix = F.regexp_extract(rest, "^([^/]*)", 1), F.regexp_extract(rest, "^[^/]*/(.*)$", 1)
    host = F.when(scheme == "s3", F.concat(F.lit("https://"), bucket, F.lit(".s3.amazonaws.com"))).otherwise(F.concat(F.lit("https://storage.googleapis.com/"), bucket))
    base = F.when(scheme == "", bare).otherwise(F.concat(host, F.when(prefix == "", "").otherwise(F.concat(F.lit("/"), prefix))))
    none = F.lit(None).cast("string")
    return F.struct(F.when(scheme == "", "http").otherwise(scheme).alias("kind"), base.alias("base"), F.when(scheme == "", none).otherwise(bucket).alias("bucket"), F.when(scheme == "", none).otherwise(prefix).alias("prefix"))


def cache_key(url: Column) -> Column:
    """A name for what is kept of a URL."""
    return F.md5(F.concat(url, F.lit("\n")))
