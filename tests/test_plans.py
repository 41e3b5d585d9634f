"""Composed event and object copies."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanferry.operators.payload import distinct_attachments, planned_copies
from spanferry.plans.event_copy import copy_events, staged_copy, write_event_copy
from spanferry.plans.object_copy import CODE_BUNDLE, Scope, copy_objects, copy_type, new_id
from tests.test_functions import reference

EVENTS = (
    "id string, _pagination_key string, _xact_id string, created timestamp, project_id string, experiment_id string, "
    "input string, output string, scores string, origin struct<object_type: string, object_id: string, id: string, _xact_id: string, created: timestamp>, "
    "_object_delete boolean"
)
TYPED = "resource_type string, source_id string, dest_id string"


def events(spark, *rows):
    data = [(i, k, x, None, "proj", exp, text, None, None, None, gone) for i, k, x, exp, text, gone in rows]
    return spark.createDataFrame(data, EVENTS).withColumn("created", F.lit("2020-01-05").cast("timestamp"))


def test_experiment_events(spark, tmp_path):
    df = events(spark, ("a", "p1", "10", "e1", "x", None), ("d", "p1.5", "9", "e1", "x", True), ("a", "p2", "8", "e1", "y", None), ("s", "p3", "1", "e2", "z", None))
    out = copy_events(df, "experiments", target=spark.createDataFrame([("s",)], "id string"))
    row = out.rows.first()
    assert out.rows.count() == 1 and row["input"] == "x" and row["experiment_id"] == "e1"
    assert tuple(row["origin"])[:4] == ("experiment", "e1", "a", "10")
    assert not {"_pagination_key", "_xact_id", "project_id"} & set(out.rows.columns)
    c = out.counters().first()
    assert (c["fetched"], c["inserted"], c["skipped_deleted"], c["skipped_seen"]) == (4, 1, 1, 2)
    out.rows.write.parquet(str(tmp_path / "written"))
    assert out.counters(spark.read.parquet(str(tmp_path / "written"))).first() == c


def test_logs_keep_tombstones(spark):
    out = copy_events(events(spark, ("a", "p1", "1", None, "x", True)), "logs")
    assert out.rows.first()["_object_delete"] is True and out.rows.first()["origin"]["object_id"] == "proj"
    assert out.counters().first()["skipped_deleted"] == 0


def test_experiment_events_need_an_owner(spark):
    with pytest.raises(Exception, match="without experiment_id"):
        copy_events(events(spark, ("a", "p1", "1", None, "x", None)), "experiments").rows.collect()


def test_attachments_and_spill_in_one_copy(spark):
    df = events(
        spark, ("a", "p1", "1", "e1", json.dumps({"f": reference("src"), "pad": "x" * 100}), None),
        ("b", "p2", "1", "e1", json.dumps({"pad": "y" * 5000}), None),
    )
    copies = planned_copies(distinct_attachments(df, "input"), "s")
    out = copy_events(df, "experiments", ref_map=copies, payload="input", max_row_bytes=1000, min_field_bytes=100)
    rows = {r["id"]: r for r in out.rows.collect()}
    assert rows["a"]["attachments_copied"] == 1 and json.loads(rows["a"]["input"])["f"]["key"] != "src"
    assert rows["b"]["spilled_fields"] == 1 and json.loads(rows["b"]["input"])["filename"] == "input.json"
    assert out.side.first()["payload"] == json.dumps({"pad": "y" * 5000})
    c = out.counters().first()
    assert (c["attachments_copied"], c["spilled_fields"], c["inserted"]) == (1, 1, 2)


def test_several_objects_in_one_scan(spark, tmp_path):
    df = events(spark, *[(f"ds{i}", f"p{i}", "1", f"e{i}", "x", None) for i in (1, 2, 3)])
    id_map = spark.createDataFrame([("experiment", f"e{i}", f"D{i}") for i in (1, 2, 3)], TYPED)
    copied = copy_events(df, "experiments")
    written = write_event_copy(copied, "experiments", id_map, str(tmp_path / "out"))
    assert sorted((r["id"], r["experiment_id"], r["origin"]["object_id"]) for r in written.collect()) == [
        ("ds1", "D1", "e1"), ("ds2", "D2", "e2"), ("ds3", "D3", "e3"),
    ]
    assert copied.counters(written).first()["inserted"] == 3
    with pytest.raises(Exception, match="no destination"):
        write_event_copy(copied, "experiments", id_map.where("source_id = 'e1'"), str(tmp_path / "other"))
    logs = copy_events(df, "logs")
    projects = spark.createDataFrame([("project", "proj", "P")], TYPED)
    row = write_event_copy(logs, "logs", projects, str(tmp_path / "logs")).first()
    assert (row["project_id"], row["log_id"]) == ("P", "g")


def test_stage_order(spark):
    seen = []
    mark = lambda name: lambda df: (seen.append(name), df)[1]
    staged_copy(
        spark.range(1), spill=mark("spill"), size=mark("size"), rewrite=mark("rewrite"), unseen=mark("unseen"), shape=mark("shape"),
        keep=mark("keep"), sink=lambda df: seen.append("sink"),
    )
    assert seen == ["keep", "shape", "unseen", "rewrite", "size", "spill", "sink"]


@pytest.fixture(scope="module")
def empty_map(spark):
    return spark.createDataFrame([], TYPED)


def test_objects_end_to_end(spark, empty_map):
    fn_type = (
        "id string, name string, project_id string, function_data struct<type: string, code: string, data: struct<type: string, code: string>>, "
        "origin struct<object_type: string, object_id: string>"
    )
    ref = "array<struct<type: string, id: string, name: string>>"
    sources = {
        "dataset": spark.createDataFrame([("d1", "known", "p"), ("d2", "new", "p")], "id string, name string, project_id string"),
        "function": spark.createDataFrame(
            [
                ("f1", "inline", "p", ("code", None, ("inline", "x")), ("dataset", "d1")),
                ("f2", "bundle", "p", ("code", None, ("bundle", None)), None),
                ("f3", "llm", "p", ("prompt", None, None), ("dataset", "gone")),
            ],
            fn_type,
        ),
        "prompt": spark.createDataFrame(
            [("p1", "base", "s", "p", ([("function", "f1", None), ("function", "f2", None), ("global", None, "G")], None)),
             ("p2", "derived", "s", "p", (None, ("p1", "p")))],
            f"id string, name string, slug string, project_id string, prompt_data struct<tool_functions: {ref}, origin: struct<prompt_id: string, project_id: string>>",
        ),
        "project_score": spark.createDataFrame(
            [("s1", "score", "p", ((0.5, [("function", "f1", None), ("slug", "x", None)]),)), ("s2", "plain", "p", None)],
            f"id string, name string, project_id string, config struct<online: struct<sampling_rate: double, scorers: {ref}>>",
        ),
        "experiment": spark.createDataFrame(
            [("e1", "base", "p", None, "d1", "p1", "v1"), ("e2", "next", "p", "e1", "gone", "gone", "v2")],
            "id string, name string, project_id string, base_exp_id string, dataset_id string, parameters_id string, parameters_version string",
        ),
        "view": spark.createDataFrame([("v1", "view", "e1", "experiment"), ("v2", "all", "p", "project")], "id string, name string, object_id string, object_type string"),
        "role": spark.createDataFrame([("r1", "admin", None, "o"), ("r2", "sub", ["r1"], "o")], "id string, name string, member_roles array<string>, org_id string"),
        "group": spark.createDataFrame([("g1", "team", [], ["u1", "u9"])], "id string, name string, member_groups array<string>, member_users array<string>"),
        "acl": spark.createDataFrame(
            [("a1", "experiment", "e1", None, "g1", "read", None, None), ("a2", "experiment", "gone", None, "g1", "read", None, None)],
            "id string, object_type string, object_id string, user_id string, group_id string, permission string, role_id string, restrict_object_type string",
        ),
    }
    users = spark.createDataFrame([("user", "u1", "U1")], TYPED)
    existing = {"dataset": spark.createDataFrame([("D", "known")], "id string, name string")}
    scope = Scope(project_id="P", org_id="O", map_users=True)
    copies, results, id_map = copy_objects(sources, existing, users, scope, project="main")
    made = lambda kind: {r["source_id"]: r for r in copies[kind].create.collect()}
    ids = {(r["resource_type"], r["source_id"]): r["dest_id"] for r in id_map.collect()}

    assert set(made("dataset")) == {"d2"} and ids[("dataset", "d1")] == "D"
    functions = made("function")
    assert set(functions) == {"f1", "f3"}
    assert functions["f1"]["origin"]["object_id"] == "D" and functions["f3"]["origin"] is None
    assert functions["f1"]["project_id"] == "P" and functions["f1"]["id"] == ids[("function", "f1")]
    prompts = made("prompt")
    tools = [tuple(t) for t in prompts["p1"]["prompt_data"]["tool_functions"]]
    assert tools == [("function", ids[("function", "f1")], None), ("global", None, "G")]
    assert tuple(prompts["p2"]["prompt_data"]["origin"]) == (ids[("prompt", "p1")], "P")
    scores = made("project_score")
    assert [tuple(s) for s in scores["s1"]["config"]["online"]["scorers"]] == [("function", ids[("function", "f1")], None)]
    assert scores["s1"]["config"]["online"]["sampling_rate"] == 0.5 and scores["s2"]["config"] is None
    experiments = made("experiment")
    assert (experiments["e1"]["dataset_id"], experiments["e1"]["parameters_id"], experiments["e1"]["parameters_version"]) == ("D", ids[("prompt", "p1")], "v1")
    assert experiments["e2"]["base_exp_id"] == ids[("experiment", "e1")]
    assert (experiments["e2"]["dataset_id"], experiments["e2"]["parameters_id"], experiments["e2"]["parameters_version"]) == (None, None, None)
    views = made("view")
    assert views["v1"]["object_id"] == ids[("experiment", "e1")] and views["v2"]["object_id"] == "P"
    assert made("role")["r2"]["member_roles"] == [ids[("role", "r1")]] and "org_id" not in copies["role"].create.columns
    assert made("group")["g1"]["member_users"] == ["U1"]
    acls = made("acl")
    assert set(acls) == {"a1"} and acls["a1"]["object_id"] == ids[("experiment", "e1")] and acls["a1"]["group_id"] == ids[("group", "g1")]

    why = {(r["resource_type"], r["source_id"]): r["skip_reason"] for r in results.where("skipped").collect()}
    assert why == {("dataset", "d1"): "already_migrated", ("function", "f2"): CODE_BUNDLE, ("acl", "a2"): "unresolved_object_dependency"}


def test_second_run_creates_nothing(spark, empty_map):
    datasets = spark.createDataFrame([("d1", "a", "p")], "id string, name string, project_id string")
    first = copy_type(datasets, "dataset", empty_map, Scope(project_id="P"))
    again = copy_type(datasets, "dataset", first.id_map, Scope(project_id="P"))
    assert first.create.count() == 1 and again.create.count() == 0
    assert again.results.first()["skip_reason"] == "already_migrated"
    expected = spark.range(1).select(new_id("dataset", F.lit("d1"), "P").alias("x")).first()["x"]
    assert first.create.first()["id"] == again.results.first()["dest_id"] == expected


def test_members_are_dropped_without_user_mapping(spark, empty_map):
    groups = spark.createDataFrame([("g1", "team", None, ["u1"])], "id string, name string, member_groups array<string>, member_users array<string>")
    assert copy_type(groups, "group", empty_map, Scope(org_id="O")).create.first()["member_users"] is None
