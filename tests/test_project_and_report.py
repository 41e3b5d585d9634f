from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanferry.operators import project, report
from spanferry.plans.event_copy import copy_counters
from spanferry.sources import sinks


def test_allow_lists(spark):
    row = spark.createDataFrame([("1", "x", "i", "o", "s", "k")], "id string, _xact_id string, input string, output string, scores string, _pagination_key string")
    assert project.event_insert_projection(row, "logs").columns == ["id", "input", "output", "scores"]
    assert project.event_insert_projection(row, "datasets").columns == ["id", "input"]
    # A schema comes first for datasets and experiments, never for logs; the id is always kept.
    assert project.event_insert_projection(row, "datasets", ["output"]).columns == ["id", "output"]
    assert project.event_insert_projection(row, "experiments", []).columns == ["id", "input", "output", "scores"]
    assert project.event_insert_projection(row, "logs", ["output"]).columns == ["id", "input", "output", "scores"]
    assert project.strip_readonly(row).columns == ["input", "output", "scores"]
    assert project.project_allowed(row, {"scores", "input", "nothing"}).columns == ["input", "scores"]


def test_tombstones_are_strict(spark):
    rows = spark.createDataFrame([("a", None), ("b", True), ("c", False)], "id string, _object_delete boolean")
    assert sorted(r["id"] for r in project.drop_tombstones(rows, "_object_delete").collect()) == ["a", "c"]


def test_created_range_is_half_open(spark):
    rows = spark.sql("select * from values (timestamp'2020-01-01'), (timestamp'2020-01-02'), (timestamp'2020-01-03') as t(created)")
    assert project.created_between(rows, "created", "2020-01-01", "2020-01-03").count() == 2
    assert project.created_between(rows, "created", None, "").count() == 3


def test_object_id_is_required(spark):
    rows = spark.createDataFrame([("a", "e1"), ("b", None)], "id string, experiment_id string")
    assert project.require_object_id(rows.where("id = 'a'"), "experiment_id").count() == 1
    with pytest.raises(PySparkException, match="without experiment_id"):
        project.require_object_id(rows, "experiment_id").collect()


def test_origin(spark):
    rows = spark.createDataFrame([("a", "5", None), ("b", None, ("x", "y", "z", None, None))],
        "id string, _xact_id string, origin struct<object_type: string, object_id: string, id: string, _xact_id: string, created: timestamp>")
    got = {r["id"]: tuple(r["origin"]) for r in project.stamp_origin(rows, "dataset", F.lit("d1")).collect()}
    assert got == {"a": ("dataset", "d1", "a", "5", None), "b": ("x", "y", "z", None, None)}


def test_requested_types(spark):
    rows = spark.createDataFrame([("datasets",), ("acls",), ("logs",)], "t string")
    pick = lambda wanted: {r["t"] for r in project.select_resource_types(rows, "t", wanted, ["datasets", "logs"]).collect()}
    assert pick(["all"]) == {"datasets", "logs"} and pick(["logs", "acls"]) == {"logs"} and pick(["acls"]) == set()


def test_names(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    found, missing = project.select_by_name(rows, "name", spark.createDataFrame([("b",), ("c",), ("c",)], "n string"))
    assert [r["name"] for r in found.collect()] == ["b"] and [r["name"] for r in missing.collect()] == ["c"]
    everything, none = project.select_by_name(rows, "name")
    assert everything.count() == 2 and none is None
    assert [r["name"] for r in report.missing_names(spark.createDataFrame([("b",), ("c",)], "n string"), rows).collect()] == ["c"]


RESULTS = "scope string, project string, resource_type string, source_id string, dest_id string, name string, success boolean, skipped boolean, skip_reason string, error string"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [
            ("project", "p", "dataset", "1", "D1", "n1", True, False, None, None),
            ("project", "p", "dataset", "2", "D2", "n2", True, True, "already_migrated", None),
            ("project", "p", "function", "3", None, None, True, True, "code_bundle_not_migratable", None),
            ("project", "p", "function", "4", None, None, True, True, "already_migrated", None),
            ("organization", None, "role", "5", None, "n5", False, None, None, "boom"),
        ],
        RESULTS,
    )


def test_counts_and_rollup(results):
    assert tuple(report.status_counts(results).first()) == (5, 1, 3, 1)
    rolled = {(r["project"], r["resource_type"], r["level"]): r["total"] for r in report.status_rollup(results).collect()}
    assert rolled[("p", "dataset", 0)] == 2 and rolled[("p", None, 1)] == 4
    assert rolled[(None, "role", 0)] == 1 and rolled[(None, None, 1)] == 1 and rolled[(None, None, 3)] == 5


def test_skip_summary_in_first_seen_order(results):
    broken = report.skip_breakdown(results, "source_id")
    assert report.skip_summary(broken).first()["summary"] == "2 already migrated, 1 code bundle not migratable"
    top = report.top_n_per_reason(results.where("skipped"), ["source_id"], n=1)
    assert {(r["skip_reason"], r["source_id"], r["more"]) for r in top.collect()} == {("already_migrated", "2", 1), ("code_bundle_not_migratable", "3", 0)}


def test_success(results):
    assert report.report_success(results).first()["success"] is False
    assert report.report_success(results.where("success")).first()["success"] is True
    assert report.report_success(results.where("false")).first()["success"] is True


def test_report_files(spark, results, tmp_path):
    sinks.write_report(results, str(tmp_path / "report"))
    summary = spark.read.json(str(tmp_path / "report/summary"))
    assert summary.where("level = 3").first()["failed"] == 1
    items = {r["source_id"]: r for r in spark.read.parquet(str(tmp_path / "report/breakdown")).collect()}
    assert items["5"]["outcome"] == "failed" and items["5"]["error"] == "boom" and items["1"]["skip_reason"] is None
    nested = {r["project"]: r["resources"] for r in spark.read.json(str(tmp_path / "report/projects")).collect()}
    assert [r["resource_type"] for r in nested["p"]] == ["dataset", "function"]
    # A later report without failures leaves nothing of this one.
    sinks.write_report(results.where("success"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary")).where("level = 3").first()["failed"] == 0
    assert spark.read.parquet(str(tmp_path / "report/breakdown")).where("outcome = 'failed'").count() == 0


@pytest.mark.parametrize(
    "ids, expected", [(["9", "10"], "10"), (["9", "x", "10"], "x"), (["", None], None), ([None], None), (["99999999999999999999", "3"], "99999999999999999999")]
)
def test_max_xact(spark, ids, expected):
    df = spark.createDataFrame([(i,) for i in ids], "x string")
    assert report.max_xact(df, "x").first()["max_xact"] == expected


def test_throughput(spark):
    counters = spark.createDataFrame([(8, 2_000_000_000)], "inserted long, inserted_bytes long")
    row = report.throughput(counters, F.lit(2.0)).first()
    assert (row["rows_total"], row["gb_total"], row["rows_per_sec"], row["gb_per_sec"]) == (8, 2.0, 4.0, 1.0)
    assert report.throughput(counters, F.lit(0)).first()["rows_per_sec"] is None


def test_copy_counters_add_up(spark):
    fetched = spark.createDataFrame([("a", None), ("d", True), ("a", None)], "id string, gone boolean")
    inserted = spark.createDataFrame([("a", 10)], "id string, row_bytes long")
    row = copy_counters(fetched, inserted, F.col("gone")).first()
    assert (row["fetched"], row["inserted"], row["skipped_deleted"], row["skipped_seen"], row["inserted_bytes"]) == (3, 1, 1, 1, 10)


def test_schema_diff(spark):
    kind = "path string, type string, value string"
    old = spark.createDataFrame([("a", "s", "1"), ("b", "s", "1"), ("c", "s", "1"), ("d", "s", None), ("e", "s", None)], kind)
    new = spark.createDataFrame([("a", "s", "1"), ("b", "n", "1"), ("c", "s", "x" * 200), ("d", "s", None), ("f", "s", "1"), ("g", "s", "1")], kind)
    got = {(r["change"], r["path"]): r for r in report.schema_diff(old, new, max_items=1).collect()}
    assert set(got) == {("type_changes", "b"), ("values_changed", "c"), ("removed", "e"), ("added", "f")}
    lists = report.schema_diff(old.limit(0), spark.createDataFrame([("t[0]", "s", "1")], kind)).first()
    assert lists["change"] == "iterable_added"
    assert got[("added", "f")]["more"] == 1 and len(got[("values_changed", "c")]["new_value"]) == 160


def test_discovery(spark):
    df = spark.createDataFrame([("d", "n3", 3), ("d", None, 1), ("d", "n2", 2), ("d", "n4", 4), ("e", "m", 1)], "kind string, name string, pos int")
    got = {r["kind"]: (r["discovered"], r["sample_names"]) for r in report.discovery_summary(df, "kind", "name", ["pos"]).collect()}
    assert got == {"d": (4, ["unnamed", "n2", "n3"]), "e": (1, ["m"])}


def test_routed_write(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1), ("e2", 2), ("e1", 3)], "experiment_id string, v int")
    routes = spark.createDataFrame([("e1", "D1"), ("e2", "D2")], "source_id string, dest_id string")
    path = str(tmp_path / "routed")
    sinks.write_routed(rows, routes, "experiment_id", "dest", path, ["v"])
    back = spark.read.parquet(path)
    assert sorted((r["dest"], r["v"]) for r in back.collect()) == [("D1", 1), ("D1", 3), ("D2", 2)]
    with pytest.raises(PySparkException, match="no destination for dest e2"):
        sinks.write_routed(rows, routes.where("source_id = 'e1'"), "experiment_id", "dest", path)
    with pytest.raises(PySparkException, match="row without experiment_id"):
        sinks.write_routed(rows.withColumn("experiment_id", F.lit(None).cast("string")), routes, "experiment_id", "dest", path)
    assert sorted(p.name for p in (tmp_path / "routed").glob("copy_run=*/dest=*")) == ["dest=D1", "dest=D2"]


def test_routed_write_of_very_many_destinations(spark, tmp_path):
    many = spark.range(1_200).selectExpr("concat('e', id) AS experiment_id", "id AS v")
    routes = many.selectExpr("experiment_id AS source_id", "concat('D', v) AS dest_id")
    path = str(tmp_path / "routed")
    for _ in range(2):
        sinks.write_routed(many, routes, "experiment_id", "dest", path, ["v"], run="first")
    assert not list((tmp_path / "routed").glob("copy_run=*/dest=*"))
    # A run of few destinations follows the layout it finds.
    sinks.write_routed(many.where("v < 2"), routes.limit(2), "experiment_id", "dest", path, ["v"], run="second")
    back = spark.read.parquet(path)
    assert back.count() == 1_202 and back.where("dest = concat('D', v)").count() == 1_202
    few = str(tmp_path / "few")
    sinks.write_routed(many.where("v < 2"), routes.where("source_id IN ('e0', 'e1')"), "experiment_id", "dest", few, ["v"])
    sinks.write_routed(many.where("v < 4"), routes, "experiment_id", "dest", few, ["v"])
    assert len(list((tmp_path / "few").glob("copy_run=*/dest=*"))) == 6 and spark.read.parquet(few).count() == 6
