"""python -m cellmill SOURCE DEST [--overwrite] [--gzip LEVEL] [--assay NAME] [--quiet]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cellmill", description="Convert between single-cell formats.")
    p.add_argument("source")
    p.add_argument("dest")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--gzip", type=int, default=1, help="compression level, 0 to 9")
    p.add_argument("--assay", help="the assay or modality to convert")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(args)
    from .sources.formats import convert

    spark = SparkSession.builder.appName("cellmill").getOrCreate()
    if a.quiet:
        spark.sparkContext.setLogLevel("ERROR")
    try:
        convert(spark, a.source, a.dest, a.overwrite, a.assay, level=a.gzip)
    except ValueError as e:
        print(f"cellmill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
