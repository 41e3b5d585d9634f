from __future__ import annotations

import json

import pytest

from spanferry.plans.event_copy import copy_events
from spanferry.sources.catalog import list_catalog, read_table
from spanferry.sources.schemas import CONTROL, OBJECTS, schema_of
from spanferry.sources.sinks import quarantine
from pyspark.sql import functions as F


def test_json_lines_keep_free_json_as_text(spark, tmp_path):
    row = {
        "id": "a", "_pagination_key": "p1", "created": "2020-01-05T00:00:00Z", "experiment_id": "e1", "_object_delete": False,
        "input": {"q": "🙂", "n": [1, 2]}, "scores": {"s": 0.5}, "unknown": 1, "tags": ["x"],
    }
    (tmp_path / "events.json").write_text(json.dumps(row, ensure_ascii=False) + "\n")
    events = read_table(spark, str(tmp_path / "events.json"), "events", "json")
    assert "unknown" not in events.columns
    out = copy_events(events, "experiments").rows.first()
    assert json.loads(out["input"]) == row["input"] and out["tags"] == ["x"] and json.loads(out["scores"]) == {"s": 0.5}
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "events.json"), fmt="json")


@pytest.mark.parametrize("kind", ["events", *OBJECTS, *CONTROL])
def test_schemas_parse(spark, kind):
    assert spark.createDataFrame([], schema_of(kind)).columns


def test_quarantine_record_has_its_fixed_shape(spark):
    events = spark.createDataFrame([], schema_of("events"))
    _, summary = quarantine(events, F.octet_length("input"), 10, "s", F.lit("d"))
    expected = spark.createDataFrame([], schema_of("quarantine"))
    assert [(f.name, f.dataType.simpleString()) for f in summary.schema] == [(f.name, f.dataType.simpleString()) for f in expected.schema]


def test_listing(spark):
    views = spark.createDataFrame([("1", "p", "project"), ("2", "p", "experiment"), ("3", "q", "project")], "id string, object_id string, object_type string")
    assert {r["id"] for r in list_catalog(views, "p", "object_id", "project").collect()} == {"1"}
    assert list_catalog(views).count() == 3
