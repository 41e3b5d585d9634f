"""Null and blank keys lose no rows."""

from __future__ import annotations

from spanferry.operators.batching import flush_groups
from spanferry.operators.dedup import anti_seen
from spanferry.operators.report import top_n_per_reason


def test_flush_groups_keep_a_null_stream(spark):
    rows = [(s, i, 1) for s in ("a", None) for i in range(5)]
    out = flush_groups(spark.createDataFrame(rows, "s string, k long, b long"), ["s"], ["k"], "b", 2, 4, 100).collect()
    assert sum(r.page_rows for r in out) == 10 and {r.s for r in out} == {"a", None}


def test_top_n_lists_items_without_a_reason(spark):
    rows = [("x", 1), (None, 2), (None, 3)]
    out = top_n_per_reason(spark.createDataFrame(rows, "skip_reason string, at long"), ["at"], n=1).collect()
    assert {(r.skip_reason, r["items"], r.more) for r in out} == {("x", 1, 0), ("unknown", 2, 1)}


def test_anti_seen_keeps_rows_without_an_id(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "id string")
    stored = spark.createDataFrame([("a",), ("",), (None,)], "id string")
    assert sorted(str(r.id) for r in anti_seen(rows, stored, ["id"]).collect()) == ["", "None", "b"]
