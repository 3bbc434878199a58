"""What the operators share: materialised intermediates, hidden column names, ASCII folding in SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Tables written between two collections of the driver.
GC_EVERY = 8
#: Whether Spark deletes a query's shuffle files as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_count = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and
    everything runs on this machine."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder := tempfile.mkdtemp(prefix="cellmill-"))
    return sc.getCheckpointDir() or folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and a join
    above it gets exchanges of its own, which adaptive execution can split when a key is hot. The shuffle files that it
    took go at once: right after a write the driver still refers to them, so a collection would leave them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellmill-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    global _count
    _count += 1
    if _count % GC_EVERY == 0:
        clean(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellmill_path = path
    return out


def clean(spark: SparkSession) -> None:
    """Shuffle files of what is cut off, and the driver's own garbage, go only when the driver collects."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for these tables; nothing may be read from them any more."""
    for df in tables:
        entry = (df.sparkSession, df._cellmill_path)
        if entry in _written:
            _delete(*entry)
            _written.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be deleted through it
            return


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an output would clash with (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
