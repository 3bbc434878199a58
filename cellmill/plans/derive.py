"""A container derived from the star-schema tables: suppliers are cells, parts are features, quantities are counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = positions(table(spark, sf_dir, "supplier"), "s_suppkey", out="obs_idx").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("obs_idx", F.col("s_name").alias("obs_id"), F.col("n_name").alias("grp"), "s_suppkey", "s_acctbal")


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(table(spark, sf_dir, "part"), "p_partkey", out="var_idx")
    return rows.select("var_idx", F.col("p_name").alias("var_id"), F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("highly_variable"), "p_partkey", "p_size", "p_retailprice")


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts: duplicates are summed before anything is joined."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("value"))
    rows, cols = obs(spark, sf_dir).select("obs_idx", "s_suppkey"), var(spark, sf_dir).select("var_idx", "p_partkey")
    return cells.join(rows, F.col("l_suppkey") == F.col("s_suppkey")).join(cols, F.col("l_partkey") == F.col("p_partkey")).select("obs_idx", "var_idx", "value")


#: The same as SQL.
CTE = """obs as (select row_number() over (order by s_suppkey) - 1 as obs_idx, s_name as obs_id, n_name as grp, s_suppkey, s_acctbal from supplier join nation on s_nationkey = n_nationkey),
var as (select row_number() over (order by p_partkey) - 1 as var_idx, p_name as var_id, p_brand as brand, p_size > 25 as highly_variable, p_partkey, p_size, p_retailprice from part),
coo as (select obs_idx, var_idx, sum(l_quantity)::bigint as value from lineitem join obs on l_suppkey = s_suppkey join var on l_partkey = p_partkey group by 1, 2)"""
