"""Every core query against its SQL twin in DuckDB, at the smallest scale; functions at their edges."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellmill.functions.names import make_unique, sanitize_column
from cellmill.operators.joins import DataError, slice_rows
from cellmill.operators.order import islands, positions, running_sum
from cellmill.streaming.arrivals import windowed_spots

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    twin = duck.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(twin.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [twin.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[k]) for k in at) for r in twin.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_make_unique_skips_taken_suffixes(spark):
    names = ["a", "a", "a.1", "a", "b", "a.1", "b.2", "b", "b"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, n string")
    got = [r.u for r in make_unique(df, "n", "i", "u").orderBy("i").collect()]
    assert len(set(got)) == len(got) and [g for g, n in zip(got, names, strict=True) if g == n] == ["a", "a.1", "b", "b.2"]
    assert got == ["a", "a.2", "a.1", "a.3", "b", "a.1.1", "b.2", "b.1", "b.3"]


def test_sanitize(spark):
    df = spark.createDataFrame([("a/b c",), ("__x__",), ("1;2",), ("",)], "n string").select(sanitize_column(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["a_b_c", "x", "X1_2", ""]


def test_order(spark):
    df = spark.range(10000).withColumn("v", F.col("id") % 7)
    last = running_sum(df, "v", "id").orderBy(F.desc("id")).first()
    assert last.running == sum(k % 7 for k in range(10000))
    assert [r.idx for r in positions(spark.createDataFrame([(5,), (100000,), (7,)], "k long"), "k").orderBy("k").collect()] == [0, 1, 2]
    runs = islands(spark.createDataFrame(list(enumerate("aabba")), "i long, x string"), "x", "i").orderBy("i").collect()
    assert [r.island for r in runs] == [1, 1, 2, 2, 3]


def test_slice_rows(spark):
    df = spark.range(5).withColumnRenamed("id", "i").withColumn("v", F.col("i") * 10)
    assert [(r.new_idx, r.v) for r in slice_rows(df, "i", [4, 0, 4]).orderBy("new_idx").collect()] == [(0, 40), (1, 0), (2, 40)]
    assert [r.v for r in slice_rows(df, "i", [True, False, False, True, False], 5).orderBy("new_idx").collect()] == [0, 30]
    for bad in ([9], [-1]):
        with pytest.raises(DataError):
            slice_rows(df, "i", bad, 5)
    with pytest.raises(DataError):
        slice_rows(df, "i", [True], 5)


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in").select("ts", (F.col("event_id") % 3).alias("x"), F.lit(0).alias("y"), F.col("event_type").alias("gene"))
    q = windowed_spots(stream).writeStream.outputMode("complete").format("memory").queryName("spots").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(value) s from spots").first().s == events.count()
