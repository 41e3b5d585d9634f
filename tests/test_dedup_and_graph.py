from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanferry.operators import dedup, graph
from spanferry.operators.joins import JoinLimits

SALTED = JoinLimits(max_rows=0)


def test_older_version_on_a_later_page_is_dropped(spark):
    rows = spark.createDataFrame([("a", "p1", 10), ("b", "p2", 9), ("a", "p3", 8)], "id string, k string, x int")
    assert sorted((r["id"], r["k"]) for r in dedup.dedup_first(rows, ["id"], ["k"]).collect()) == [("a", "p1"), ("b", "p2")]
    counts = dedup.dedup_counts(rows, ["id"]).first()
    assert (counts["fetched"], counts["kept"], counts["skipped_seen"], counts["no_id"]) == (3, 2, 1, 0)


def test_rows_without_id_stay(spark):
    rows = spark.createDataFrame([(None, "1"), (None, "1"), ("", "2"), ("a", "3"), ("a", "4")], "id string, k string")
    assert dedup.dedup_first(rows, ["id"], ["k"]).count() == 4
    counts = dedup.dedup_counts(rows, ["id"]).first()
    assert (counts["fetched"], counts["kept"], counts["skipped_seen"], counts["no_id"]) == (5, 4, 1, 3)
    empty = dedup.dedup_counts(rows.where("false"), ["id"]).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_dedup_limits_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 3).alias("id"), F.col("id").alias("k"))
    plan = dedup.dedup_first(rows, ["id"], ["k"], ids_present=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED])
@pytest.mark.parametrize("tied", [False, True])
def test_wide_dedup_keeps_the_same_rows(spark, limits, tied):
    n = F.col("id")
    named = F.when(n % 3 == 0, "hot").when(n % 50 == 1, F.lit(None)).when(n % 50 == 2, "").otherwise((n % 3_900).cast("string"))
    key = n % 7 if tied else F.lit(5_000) - n
    rows = spark.range(4_000).select(named.alias("id"), key.alias("k"), (n if not tied else F.lit(1)).alias("payload"))
    expected = dedup.dedup_first(rows, ["id"], ["k"])
    got = dedup.dedup_first_wide(rows, ["id"], ["k"], limits)
    assert got.columns == expected.columns
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_wide_dedup_of_mostly_copies(spark):
    rows = spark.range(1_000).select((F.col("id") % 300).alias("id"), F.col("id").alias("k"))
    got = dedup.dedup_first_wide(rows, ["id"], ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(300)]


def test_wide_dedup_does_not_move_payloads(spark, tmp_path):
    path = str(tmp_path / "wide")
    n = F.col("id")
    spark.range(5_000).select((n % 4_990).alias("id"), n.alias("k"), F.repeat(F.lit("x"), F.lit(50)).alias("payload")).write.parquet(path)
    got = dedup.dedup_first_wide(spark.read.parquet(path), ["id"], ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert got.count() == 4_990


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED, JoinLimits(max_rows=3)])
def test_anti_seen(spark, limits):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4), ("c", 5)], "id string, v int")
    target = spark.createDataFrame([("b",), ("z",), (None,)], "id string")
    assert sorted(r["v"] for r in dedup.anti_seen(rows, target, ["id"], limits).collect()) == [1, 3, 5]


def test_small_increments_do_not_shuffle_the_target(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.range(10_000).withColumn("payload", F.lit("x")).write.parquet(path)
    increment = spark.createDataFrame([(5,), (10_001,)], "id long")
    fresh = dedup.anti_seen(increment, spark.read.parquet(path), ["id"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["id"] for r in fresh.collect()] == [10_001]


def test_skip_migrated(spark):
    objects = spark.createDataFrame([("a",), ("b",)], "id string")
    mapping = spark.createDataFrame([("a", "A")], "source_id string, dest_id string")
    got = {r["id"]: (r["dest_id"], r["skipped"], r["skip_reason"]) for r in dedup.skip_migrated(objects, mapping, "id").collect()}
    assert got == {"a": ("A", True, "already_migrated"), "b": (None, False, None)}


def test_unresolved(spark):
    edges = spark.createDataFrame([("e", "1", "d", "x"), ("e", "2", "d", "y"), ("e", "3", "f", "x")], "src_type string, src_id string, dep_type string, dep_id string")
    plain = spark.createDataFrame([("x", "X"), ("y", None)], "source_id string, dest_id string")
    assert {r["src_id"] for r in dedup.unresolved_refs(edges, plain).collect()} == {"2"}
    typed = plain.withColumn("resource_type", F.lit("d"))
    assert {r["src_id"] for r in dedup.unresolved_refs(edges, typed).collect()} == {"2", "3"}
    with pytest.raises(ValueError, match="unresolved"):
        dedup.unresolved_refs(edges, plain, strict=True)


def tiers(spark, nodes, edges, limits=JoinLimits()):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "src string, dep string")
    return {r["id"]: r["tier"] for r in graph.dependency_levels(n, e, limits).collect()}


def test_levels(spark):
    nodes = ["datasets", "experiments", "views", "functions", "prompts", "logs"]
    edges = [("experiments", "datasets"), ("views", "datasets"), ("views", "experiments"), ("functions", "datasets"), ("prompts", "functions")]
    expected = {"datasets": 0, "logs": 0, "experiments": 1, "functions": 1, "views": 2, "prompts": 2}
    assert tiers(spark, nodes, edges) == expected
    assert tiers(spark, nodes, edges, SALTED) == expected


def test_missing_prerequisites_are_ignored_and_cycles_have_no_tier(spark):
    assert tiers(spark, ["prompts", "a", "b", "c"], [("prompts", "functions"), ("a", "b"), ("b", "a"), ("c", "a")]) == {
        "prompts": 0, "a": None, "b": None, "c": None,
    }
    assert tiers(spark, ["a"], [("a", "a")]) == {"a": None}


def test_failure_closure(spark):
    edges = spark.createDataFrame(
        [("exp", "data"), ("view", "exp"), ("view", "data"), ("score", "fn"), ("loop1", "loop2"), ("loop2", "loop1"), ("loop1", "data")], "src string, dep string"
    )
    failed = spark.createDataFrame([("data",)], "id string")
    assert {r["id"] for r in graph.blocked_by_failure(edges, failed).collect()} == {"exp", "view", "loop1", "loop2"}
    assert graph.blocked_by_failure(edges, spark.createDataFrame([("view",)], "id string")).count() == 0


def test_tags_and_iframes_make_no_edges(spark):
    tags = spark.createDataFrame([("t", "p")], "id string, project_id string")
    acls = spark.createDataFrame([("a", "project", "p", None, "g")], "id string, object_type string, object_id string, role_id string, group_id string")
    got = {tuple(r) for r in graph.reference_edges({"project_tag": tags, "acl": acls}).collect()}
    assert got == {("acl", "a", "project", "p"), ("acl", "a", "group", "g")}
