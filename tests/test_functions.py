from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanferry.functions import payload, scalars
from spanferry.functions.predicates import is_code_bundle


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2026-01-15", "2026-01-15T00:00:00Z"),
        ("2026-01-15T10:30:00", "2026-01-15T10:30:00Z"),
        (" 2026-01-15T10:30:00Z ", "2026-01-15T10:30:00Z"),
        ("2026-01-15T10:30:00+02:00", "2026-01-15T08:30:00Z"),
        ("2026-01-01T00:30:00+0130", "2025-12-31T23:00:00Z"),
        ("2026-01-15 10:30:00.25", "2026-01-15T10:30:00.250000Z"),
        ("2026-01-15T10:30:00.000001-05:00", "2026-01-15T15:30:00.000001Z"),
        ("1969-12-31T23:59:59.5Z", "1969-12-31T23:59:59.500000Z"),
        ("2026-01-15T10:30", "2026-01-15T10:30:00Z"),
    ],
)
def test_canonical_ts(spark, given, expected):
    assert one(spark, given, scalars.canonical_ts) == expected


@pytest.mark.parametrize("bad", ["", "   ", "yesterday", "2026-13-01", "2026-02-30", "01/02/2026", "2026-1-5", None])
def test_canonical_ts_rejects(spark, bad):
    with pytest.raises(PySparkException, match="invalid date"):
        one(spark, bad, scalars.canonical_ts)
    assert one(spark, bad, lambda c: scalars.canonical_ts(c, strict=False)) is None


def test_canonical_ts_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, "2026-01-15T10:30:00", scalars.canonical_ts) == "2026-01-15T10:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_texts(spark):
    assert one(spark, "  A@B.Org ", scalars.norm_email) == "a@b.org"
    assert one(spark, "  ", scalars.norm_email) is None
    assert one(spark, "0123456789abcdefXYZ", scalars.short_cursor) == "0123456789abcdef…"
    assert one(spark, "abc", scalars.short_cursor) == "abc…"
    assert one(spark, None, scalars.short_cursor) is None
    assert one(spark, "already_migrated", scalars.reason_label) == "Already Migrated"
    assert one(spark, "3rd_PARTY-code", scalars.reason_label) == "3Rd Party-Code"
    assert one(spark, "x" * 160, scalars.truncate_value) == "x" * 160
    assert one(spark, "x" * 161, scalars.truncate_value) == "x" * 157 + "..."


@pytest.mark.parametrize(
    "kind, data, expected",
    [("code", "inline", False), ("code", "bundle", True), ("code", None, True), ("prompt", "bundle", False), (None, None, False)],
)
def test_code_bundle(spark, kind, data, expected):
    df = spark.createDataFrame([(kind, data)], "kind string, data string")
    assert df.select(is_code_bundle(F.col("kind"), F.col("data")).alias("r")).first()["r"] is expected


def test_sizes(spark):
    text = json.dumps({"a": "🙂漢字", "b": [1, 2]}, ensure_ascii=False)
    assert one(spark, text, payload.json_bytes) == len(text.encode())
    compact = json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
    assert one(spark, text, payload.compact_chars) == len(compact)
    assert one(spark, compact, payload.spaced_json_bytes) == len(text.encode())
    assert one(spark, "{broken", payload.compact_chars) is None
    assert one(spark, "{broken", payload.spaced_json_bytes) is None


def reference(key, **more):
    return {"type": payload.REFERENCE_TAG, "key": key, "filename": f"{key}.txt", "content_type": "text/plain", **more}


def test_references(spark):
    inner = reference("k1", nested=reference("hidden"))
    doc = {"a": inner, "b": [1, {"c": reference("k2")}], "d": {"type": payload.REFERENCE_TAG, "key": "k3"}, "e": {"type": payload.REFERENCE_TAG}}
    text = json.dumps(doc)
    refs = one(spark, text, payload.attachment_refs)
    assert [(r["path"], r["key"]) for r in refs] == [("$.a", "k1"), ("$.b[1].c", "k2")]
    # The weaker count also takes the incomplete reference, but not the one without a key.
    assert one(spark, text, payload.count_attachment_refs) == 3
    assert one(spark, "not json", payload.attachment_refs) == []
    assert one(spark, None, payload.count_attachment_refs) == 0


def test_escaped_tag_is_found(spark):
    text = json.dumps(reference("k1")).replace("stored", "\\u0073tored")
    assert [r["key"] for r in one(spark, text, payload.attachment_refs)] == ["k1"]
