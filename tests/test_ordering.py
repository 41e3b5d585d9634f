from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from spanferry.operators import ordering, scan


def test_positions_of_a_hot_stream(spark):
    stream = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 20).cast("string"))
    df = spark.range(6_000).select(stream.alias("s"), (F.lit(9_999) - F.col("id")).alias("k"))
    got = ordering.positions(df, ["k"], ["s"]).toPandas()
    expected = df.toPandas().sort_values("k")
    expected["position"] = expected.groupby("s", dropna=False).cumcount() + 1
    merged = got.merge(expected, on="k")
    assert len(merged) == 6_000 and (merged["position_x"] == merged["position_y"]).all()


def test_positions_without_stream(spark):
    df = spark.range(5_000).select((F.col("id") * 7 % 5_003).alias("k"))
    got = sorted((r["k"], r["position"]) for r in ordering.positions(df, ["k"]).collect())
    assert [p for _, p in got] == list(range(1, 5_001))


def test_ordered_copy_is_sorted_across_partitions(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_009).alias("k")).repartition(8)
    rows = ordering.ordered_copy(df, "k").withColumn("p", F.spark_partition_id()).collect()
    keys = [r["k"] for r in sorted(rows, key=lambda r: r["p"])]
    assert keys == sorted(keys)


def test_two_pass_order_is_stable(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, ""), (5, None)], "pos int, parent string")
    got = [(r["pos"], r["create_pass"]) for r in ordering.two_pass_order(df, "parent", ["pos"]).collect()]
    assert got == [(2, 1), (4, 1), (5, 1), (1, 2), (3, 2)]


def test_object_group_names(spark):
    df = spark.createDataFrame([(f"e{i}", i) for i in range(51)], "id string, pos int")
    groups = {r["group_no"]: r for r in ordering.object_groups(df, "id", ["pos"]).collect()}
    first = [f"e{i}" for i in range(25)]
    assert groups[0]["object_ids"] == first
    assert groups[0]["group_name"] == "group_" + hashlib.sha1(",".join(first).encode()).hexdigest()[:12]
    assert groups[2]["group_name"] == "e50"


def test_page_cursors(spark):
    df = spark.createDataFrame([(c,) for c in "abcdefg"], "k string")
    got = sorted(tuple(r) for r in ordering.page_cursors(df, "k", 3).collect())
    assert got == [(0, 3, None, "c"), (1, 3, "c", "f"), (2, 1, "f", "g")]
    with pytest.raises(ValueError):
        ordering.page_cursors(df, "k", 0)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("1", "2020-01-01"), ("2", "2020-01-02"), ("3", "2020-01-03")]
    return spark.createDataFrame(rows, "k string, c string").select("k", F.col("c").cast("timestamp").alias("created"))


def test_start_key_then_page_equals_the_filter(events):
    start = scan.start_key(events, "k", "2020-01-02").first()["start_key"]
    assert start == "2"
    page = scan.keyset_page(events, "k", 10, after=start, inclusive=True, created_after="2020-01-02")
    assert [r["k"] for r in page.collect()] == ["2", "3"]
    assert scan.start_key(events, "k", "2021-01-01").first()["start_key"] is None


def test_pages_cover_everything_once(events):
    seen, last = [], None
    while rows := scan.keyset_page(events, "k", 2, after=last, select="k").collect():
        seen += [r["k"] for r in rows]
        last = seen[-1]
    assert seen == ["1", "2", "3"]


def test_empty_bounds_are_no_bounds(events):
    assert scan.keyset_page(events, "k", 10, after="", created_after="", created_before=None).count() == 3


def test_scan_objects_by_list_and_table(spark, events):
    assert scan.scan_objects(events, "k", ["1", "3"]).count() == 2
    ids = spark.createDataFrame([("1",), ("1",), ("9",)], "any string")
    assert [r["k"] for r in scan.scan_objects(events, "k", ids).collect()] == ["1"]
    many = [str(i) for i in range(2, 2_000)]
    assert scan.scan_objects(events, "k", many).count() == 2


def test_bounds_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.current_timestamp().alias("created"), F.lit("x").alias("wide")).write.parquet(path)
    page = scan.keyset_page(spark.read.parquet(path), "id", 5, after=10, select=["id"])
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(id,10)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_segments_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_SEGMENT_ROWS", 100)
    df = spark.range(3_000).select((F.col("id") * 7 % 3_001).alias("k"), (F.col("id") % 2).alias("s"))
    cut, offsets = ordering.segments(df, ["k"], ["s"])
    sizes = [r["count"] for r in cut.groupBy("_seg").count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 300 and sum(sizes) == 3_000
    assert offsets.count() < len(sizes)
    got = {(r["s"], r["k"]): r["position"] for r in ordering.positions(df, ["k"], ["s"]).collect()}
    for stream in (0, 1):
        keys = sorted(k for s, k in got if s == stream)
        assert [got[(stream, k)] for k in keys] == list(range(1, 1_501))
