"""Categorical, boolean and nullable encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels_of(df: DataFrame, col: str) -> DataFrame:
    """(code, label): sorted distinct labels, numbered from 0. The table has a row a category."""
    labels = df.select(F.col(col).alias("label")).filter("label is not null").distinct()
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("code"), "label")


def encode(df: DataFrame, col: str, levels: DataFrame, out: str = "code") -> DataFrame:
    """Labels to codes; null or unlisted labels give -1."""
    known = levels.select(F.col("code").alias("__c"), F.col("label").alias("__l"))
    return df.join(known, df[col] == known["__l"], "left").withColumn(out, F.coalesce("__c", F.lit(-1).cast("long"))).drop("__c", "__l")


def decode(df: DataFrame, code: str, levels: DataFrame, out: str = "label") -> DataFrame:
    """Codes to labels; -1 and codes out of range give null."""
    known = levels.select(F.col("code").alias("__c"), F.col("label").alias("__l"))
    return df.join(known, df[code] == known["__c"], "left").withColumn(out, F.col("__l")).drop("__c", "__l")


def code_width(n: Column) -> Column:
    """The narrowest storage type that holds codes of n categories."""
    return F.when(n <= 127, "int8").when(n <= 255, "uint8").when(n <= 32767, "int16").when(n <= 65535, "uint16").otherwise("int32")


def one_based(code: Column) -> Column:
    """0-based codes to 1-based values; -1 to null."""
    return F.when(code >= 0, code + 1)


def bool_to_int(flag: Column) -> Column:
    """Booleans as 0, 1 and 2 for null."""
    return F.coalesce(flag.cast("int"), F.lit(2))


def int_to_bool(value: Column) -> Column:
    return F.when(value != 2, value == 1)


def flatten_nullable(value: Column, mask: Column) -> Column:
    """A value under a set mask is null."""
    return F.when(~mask, value)
