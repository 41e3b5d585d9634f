"""Lookups give the same rows whether the other side is broadcast, shuffled or salted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanferry.operators.joins import JoinLimits, fits_broadcast, hot_keys, lookup

SALTED = JoinLimits(max_rows=0, salts=8)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows, null another tenth."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 10 == 1, F.lit(None)).otherwise(n % 1000)
    return spark.range(30_000, numPartitions=8).select(key.alias("k"), n.alias("v"))


@pytest.fixture(scope="module")
def names(spark):
    return spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("d")).unionByName(
        spark.createDataFrame([(7, 70)], "k long, d long")
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_equals_broadcast(skewed, names, how):
    assert hot_keys(skewed, ["k"], SALTED)
    expected = lookup(skewed, names, ["k"], how)
    salted = lookup(skewed, names, ["k"], how, SALTED)
    assert salted.columns == expected.columns
    assert salted.exceptAll(expected).count() == 0
    assert expected.exceptAll(salted).count() == 0


def test_hot_key_is_spread_over_tasks(spark, skewed, names):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(skewed, names, ["k"], "left", SALTED)
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Unsalted, the hot key alone would put 10,000 rows into one task.
    assert per_task < 8_000


def test_even_keys_are_not_salted(spark, names):
    even = spark.range(20_000).select(F.col("id").alias("k"))
    assert hot_keys(even, ["k"], SALTED) == []
    assert lookup(even, names, ["k"], "inner", SALTED).count() == names.count()


def test_broadcast_is_measured(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), F.lit(1000)).alias("s"))
    assert fits_broadcast(wide, JoinLimits(max_rows=100, max_bytes=200_000))
    assert not fits_broadcast(wide, JoinLimits(max_rows=99, max_bytes=200_000))
    assert not fits_broadcast(wide, JoinLimits(max_rows=100, max_bytes=50_000))


def test_several_keys_and_text(spark):
    left = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"), (F.col("id") % 2).alias("n"), "id"
    )
    right = spark.createDataFrame([("hot", 0, "a"), ("hot", 1, "b"), ("4", 0, "c")], "t string, n long, d string")
    got = lookup(left, right, ["t", "n"], "inner", SALTED)
    assert {(r["t"], r["d"]): r["count"] for r in got.groupBy("t", "d").count().collect()} == {
        ("hot", "a"): 1500, ("hot", "b"): 1500, ("4", "c"): 1,
    }
