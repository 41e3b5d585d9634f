"""A second run adds to what the first one wrote; a repeated attempt replaces its own rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.operators.report import discovery_summary
from spanferry.plans.event_copy import copy_counters, copy_events, write_event_copy
from spanferry.sources.sinks import write_routed
from tests.test_plans import TYPED, events


def test_routed_runs_add_up(spark, tmp_path):
    routes = spark.createDataFrame([("e1", "D1")], "source_id string, dest_id string")
    path = str(tmp_path / "routed")
    rows = lambda *vs: spark.createDataFrame([("e1", v) for v in vs], "experiment_id string, v int")
    write_routed(rows(1, 2, 3), routes, "experiment_id", "dest", path, run="a")
    write_routed(rows(4), routes, "experiment_id", "dest", path)
    write_routed(rows(1, 2, 3), routes, "experiment_id", "dest", path, run="a")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_resumed_event_copy_keeps_rows_and_moved_values(spark, tmp_path):
    ids = [f"x{i:02}" for i in range(12)]
    source = events(spark, *[(i, i, "1", "e1", "v" * 4000, None) for i in ids])
    id_map = spark.createDataFrame([("experiment", "e1", "D1")], TYPED)
    path = str(tmp_path / "out")
    options = {"max_row_bytes": 1000, "min_field_bytes": 100}
    first = copy_events(source.where(F.col("id") < "x10"), "experiments", **options)
    assert write_event_copy(first, "experiments", id_map, path).count() == 10
    second = copy_events(source, "experiments", target=spark.read.parquet(path), **options)
    written = write_event_copy(second, "experiments", id_map, path)
    assert sorted(r["id"] for r in written.collect()) == ["x10", "x11"]
    counted = second.counters(written).first()
    assert (counted["fetched"], counted["inserted"], counted["skipped_seen"], counted["spilled_fields"]) == (12, 2, 10, 2)
    stored = spark.read.parquet(path)
    assert sorted(r["id"] for r in stored.select("id").collect()) == ids
    side = spark.read.parquet(f"{path}_side")
    assert {(r["event_id"], r["payload"]) for r in side.collect()} == {(i, "v" * 4000) for i in ids}
    kept = stored.select(F.get_json_object("input", "$.key").alias("key"))
    assert kept.join(side, "key").count() == 12


def test_an_empty_run(spark, tmp_path):
    id_map = spark.createDataFrame([("experiment", "e1", "D1")], TYPED)
    nothing = events(spark, ("a", "p", "1", "e1", "x", None)).where("id = 'b'")
    assert write_event_copy(copy_events(nothing, "experiments"), "experiments", id_map, str(tmp_path / "out")).count() == 0


def test_counters_and_summaries_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "kind string, at int")
    counted = {r["kind"]: (r["inserted"], r["skipped_seen"]) for r in copy_counters(rows, rows, keys=["kind"]).collect()}
    assert counted == {None: (2, 0), "a": (1, 0)}
    named = rows.withColumn("name", F.concat(F.lit("n"), "at"))
    found = {r["kind"]: r["sample_names"] for r in discovery_summary(named, "kind", "name", ["at"]).collect()}
    assert found == {None: ["n1", "n2"], "a": ["n3"]}
