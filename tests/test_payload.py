from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanferry.operators.payload import distinct_attachments, planned_copies, rewrite_attachments, spill_oversize
from spanferry.sources.sinks import quarantine
from tests.test_functions import reference

SCHEMA = "id string, input string, output string, metadata string, scores string"


def spill(spark, rows, **options):
    out = spill_oversize(spark.createDataFrame(rows, SCHEMA), "id", "s", **options)
    return {r["id"]: r for r in out.rows.collect()}, {(r["event_id"], r["field"]): r for r in out.side.collect()}


def test_one_field(spark):
    rows, side = spill(spark, [("a", "x" * 5000, "small", "m", "1")], max_row_bytes=1000, min_field_bytes=100)
    row = rows["a"]
    assert row["spilled_fields"] == 1 and row["row_bytes"] <= 1000
    assert (row["output"], row["metadata"], row["scores"]) == ("small", "m", "1")
    left = json.loads(row["input"])
    assert left["filename"] == "input.json" and left["content_type"] == "application/json"
    assert side[("a", "input")]["payload"] == "x" * 5000 and side[("a", "input")]["key"] == left["key"]
    assert row["row_bytes"] == len(row["input"]) + len("small") + len("m")


def test_nothing_below_the_cap(spark):
    rows, side = spill(spark, [("a", "x" * 900, "y", None, None)], max_row_bytes=1000, min_field_bytes=100)
    assert rows["a"]["spilled_fields"] == 0 and rows["a"]["input"] == "x" * 900 and not side


def test_two_fields_largest_first(spark):
    rows, side = spill(
        spark,
        [("both", "x" * 3000, "y" * 3000, "m" * 200, None), ("one", "x" * 600, "y" * 3000, "m", None)],
        max_row_bytes=1000, min_field_bytes=100,
    )
    assert rows["both"]["spilled_fields"] == 2 and rows["both"]["metadata"] == "m" * 200
    assert {k for k in side if k[0] == "one"} == {("one", "output")}


def test_equal_sizes_go_in_field_order(spark):
    _, side = spill(spark, [("a", "x" * 700, "y" * 700, None, None)], max_row_bytes=1000, min_field_bytes=100)
    assert set(side) == {("a", "input")}


def test_small_fields_and_references_stay(spark):
    ref = json.dumps(reference("k")) + " " * 2000
    rows, side = spill(spark, [("a", ref, "y" * 90, None, "z" * 5000)], max_row_bytes=1000, min_field_bytes=100)
    assert rows["a"]["spilled_fields"] == 0 and not side


def test_rows_of_any_size_among_small_ones(spark):
    data = [(f"e{i}", "x" * (2_000_000 if i == 2 else 10), "y", None, None) for i in range(5)]
    rows, side = spill(spark, data, max_row_bytes=1_000_000, min_field_bytes=64 * 1024)
    assert len(rows) == 5 and sum(r["spilled_fields"] for r in rows.values()) == 1 and set(side) == {("e2", "input")}


def test_keys_are_the_same_on_every_run(spark):
    data = [("a", "x" * 5000, None, None, None)]
    first, again = (spill(spark, data, max_row_bytes=1000, min_field_bytes=100) for _ in range(2))
    assert first == again


def test_same_reference_is_copied_once(spark):
    rows = [("1", json.dumps({"a": reference("src")})), ("2", json.dumps([reference("src"), reference("other")])), ("3", "{}"), ("4", None)]
    df = spark.createDataFrame(rows, "id string, payload string")
    distinct = distinct_attachments(df, "payload")
    assert {r["source_key"] for r in distinct.collect()} == {"src", "other"}
    copies = planned_copies(distinct, "s")
    out = {r["id"]: r for r in rewrite_attachments(df, copies, "payload").collect()}
    key_1 = json.loads(out["1"]["payload"])["a"]["key"]
    assert key_1 == json.loads(out["2"]["payload"])[0]["key"] != "src"
    assert {k: r["attachments_copied"] for k, r in out.items()} == {"1": 1, "2": 2, "3": 0, "4": 0}
    assert out["3"]["payload"] == "{}" and out["4"]["payload"] is None


def test_references_without_a_copy_stay(spark):
    df = spark.createDataFrame([("1", json.dumps({"a": reference("x"), "b": reference("y")}))], "id string, payload string")
    copies = planned_copies(distinct_attachments(df, "payload").where("source_key = 'x'"), "s")
    row = rewrite_attachments(df, copies, "payload").first()
    doc = json.loads(row["payload"])
    assert row["attachments_copied"] == 1 and doc["b"] == reference("y") and doc["a"]["key"] != "x"


def test_quarantine(spark):
    doc = json.dumps({"f": reference("k"), "g": {"type": "stored_attachment", "key": "w"}})
    rows = spark.createDataFrame(
        [("big", "p1", "r", "s", doc + " " * 500, None), ("small", "p2", None, None, "{}", "x")],
        "id string, _pagination_key string, root_span_id string, span_id string, input string, output string",
    )
    kept, summary = quarantine(rows, F.octet_length("input"), 300, "logs", F.lit("dest"), payloads=["input"])
    assert [r["id"] for r in kept.collect()] == ["small"]
    row = summary.first()
    assert (row["event_id"], row["cursor"], row["dest_id"], row["root_span_id"], row["span_id"]) == ("big", "p1", "dest", "r", "s")
    assert row["attachment_refs"] == 2 and row["approx_size"] == len(doc) + 500
    assert row["top_level_keys"] == ["_pagination_key", "id", "input", "root_span_id", "span_id"]
