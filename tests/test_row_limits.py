"""Row sizes, side-table keys, isolated rows and rows without a key."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanferry.functions.payload import json_value_bytes, spaced_json_bytes
from spanferry.operators.dedup import dedup_first
from spanferry.operators.payload import row_json_bytes, spill_oversize
from spanferry.plans.event_copy import copy_events, write_event_copy
from spanferry.sources import state
from spanferry.streaming import increments, replicate

FIELDS = "id string, _pagination_key string, created timestamp, input string, note string"


def rows(spark, *items):
    return spark.createDataFrame([(i, k, None, text, note) for i, k, text, note in items], FIELDS)


def size_of(text):
    compact = dict(ensure_ascii=False, separators=(",", ":"))
    try:
        return len(json.dumps(json.loads(text), **compact).encode())
    except ValueError:
        return len(json.dumps(text, **compact).encode())


def test_value_and_row_sizes(spark):
    texts = ['{"a":[1,2.5,"é"]}', "[1,2]", '"text"', "12", "-0.5", "true", "null", "plain", 'a "quoted" \\ one\n', "é", "", "{", '"', "truest"]
    data = [(i, t, [t], {"x": i}) for i, t in enumerate(texts)] + [(99, None, None, None)]
    df = spark.createDataFrame(data, "id long, input string, tags array<string>, m map<string,long>")
    got = {r["id"]: r for r in df.select("id", json_value_bytes(F.col("input")).alias("v"), row_json_bytes(df).alias("n")).collect()}
    for i, text in enumerate(texts):
        assert got[i]["v"] == size_of(text), text
        rest = json.dumps({"id": i, "tags": [text], "m": {"x": i}}, ensure_ascii=False, separators=(",", ":"))
        assert got[i]["n"] == len(rest.encode()) + len(',"input":') + size_of(text), text
    assert got[99]["n"] == len('{"id":99}')
    lone = spark.createDataFrame([('{"a":1}', None), (None, None), ("x", "yy")], "input string, output string")
    assert sorted(r[0] for r in lone.select(row_json_bytes(lone)).collect()) == [2, len('{"input":{"a":1}}'), len('{"input":"x","output":"yy"}')]


def test_sizes_of_deep_and_unusual_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = [deep, "[" * 100_000, '{"a": [1,2]}', "[1e400,1]", "[NaN]", '["\\ud800", "\\u00e9"]', None, '{"a":1,"b":{"c":"é"}}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spaced_json_bytes(F.col("t"))).collect()]
    assert got == [200_000, None, 13 - 1 + 1, len("[1e400, 1]"), None, len('["\\ud800", "é"]') + 1, None, len('{"a": 1, "b": {"c": "é"}}') + 1]


def test_side_keys_tell_values_apart(spark):
    data = [(i, "x" * 900 + str(n)) for n, i in enumerate([None, None, "", "  ", "a", "a"])]
    moved = spill_oversize(spark.createDataFrame(data, "id string, input string"), "id", "s", max_row_bytes=500, min_field_bytes=100)
    side = {r["key"]: r["payload"] for r in moved.side.collect()}
    assert len(side) == 6
    for row in moved.rows.collect():
        assert side[json.loads(row["input"])["key"]].startswith("x")
    assert sorted(side.values()) == sorted(text for _, text in data)


def increment(df, tmp_path, **options):
    paths = (str(tmp_path / "sink"), str(tmp_path / "state"))
    return increments.copy_increment(df, *paths, "s", key="_pagination_key", ids=["id"], **options).first()


def test_rows_without_a_key_are_copied_once(spark, tmp_path):
    first = rows(spark, ("a", "p1", "x", None), ("b", None, "x", None), ("b", None, "x", None))
    now = increment(first, tmp_path)
    assert (now["fetched"], now["inserted"], now["skipped_seen"], now["last_key"]) == (3, 2, 1, "p1")
    later = first.unionByName(rows(spark, ("c", None, "x", None), ("d", "p2", "x", None), (None, "p3", "x", None)))
    now = increment(later, tmp_path)
    assert (now["inserted"], now["last_key"]) == (5, "p3")
    assert sorted(str(r["id"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["None", "a", "b", "c", "d"]
    with pytest.raises(ValueError, match="neither"):
        increment(later.unionByName(rows(spark, ("", None, "x", None))), tmp_path)
    assert state.read_state(spark, str(tmp_path / "state"), "s").first()["last_key"] == "p3"


def test_extract_takes_rows_without_a_key(spark):
    df = rows(spark, ("a", "p1", "x", None), ("b", None, "x", None), ("c", "p2", "x", None))
    at = spark.createDataFrame([("p1",)], "last_key string")
    assert sorted(r["id"] for r in increments.extract_incremental(df, at, "_pagination_key").collect()) == ["b", "c"]


# A row of 20 MiB with no field that could be moved, one that fits after a move, one that does not, one small.
LARGE = [("huge", "p1", None, "n" * (20 << 20)), ("moved", "p2", "y" * (19 << 20), None), ("both", "p3", "y" * (1 << 20), "n" * (19 << 20)), ("small", "p4", "z", "z")]


def check_isolated(spark, sink, counted):
    assert sorted(r["id"] for r in spark.read.parquet(sink).select("id").collect()) == ["moved", "small"]
    records = {r["event_id"]: r for r in spark.read.parquet(f"{sink}_quarantine").collect()}
    assert set(records) == {"huge", "both"} and records["huge"]["approx_size"] > 20 << 20
    assert records["huge"]["top_level_keys"] == ["_pagination_key", "id", "note"] and "exceeds" in records["huge"]["error"]
    assert [r["event_id"] for r in spark.read.parquet(f"{sink}_side").select("event_id").collect()] == ["moved"]
    assert (counted["fetched"], counted["inserted"], counted["quarantined"], counted["skipped_seen"], counted["spilled_fields"]) == (4, 2, 2, 0, 1)


def test_increment_isolates_rows_over_the_cap(spark, tmp_path):
    df = rows(spark, *LARGE)
    counted = increment(df, tmp_path)
    check_isolated(spark, str(tmp_path / "sink"), counted)
    assert increment(df, tmp_path)["quarantined"] == 2


def test_stream_isolates_rows_over_the_cap(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("sink", "checkpoint", "metrics", "state_path")}
    source = str(tmp_path / "source")
    df = rows(spark, *LARGE)
    df.coalesce(1).write.parquet(source)
    for _ in range(2):
        replicate.replicate_stream(spark, source, df.schema, stream="s", key="_pagination_key", ids=["id"], **paths).awaitTermination()
        check_isolated(spark, paths["sink"], replicate.partial_results(spark, paths["metrics"]).first())


def test_event_copy_isolates_rows_over_the_cap(spark, tmp_path):
    data = [("huge", "p1", "e", None, ["t" * (20 << 20)]), ("moved", "p2", "e", "y" * (19 << 20), None), ("small", "p3", "e", "z", ["t"])]
    df = spark.createDataFrame(data, "id string, _pagination_key string, experiment_id string, input string, tags array<string>")
    df = df.withColumns({"created": F.lit(None).cast("timestamp"), "_xact_id": F.lit("1")})
    id_map = spark.createDataFrame([("experiment", "e", "E")], "resource_type string, source_id string, dest_id string")
    copied = copy_events(df.unionByName(df), "experiments")
    written = write_event_copy(copied, "experiments", id_map, str(tmp_path / "out"), run="1")
    assert sorted(r["id"] for r in written.select("id").collect()) == ["moved", "small"]
    record = spark.read.parquet(str(tmp_path / "out_quarantine")).collect()
    assert [r["event_id"] for r in record] == ["huge"] and "tags" in record[0]["top_level_keys"] and "row_bytes" not in record[0]["top_level_keys"]
    counted = copied.counters(written).first()
    assert (counted["fetched"], counted["inserted"], counted["quarantined"], counted["skipped_seen"]) == (6, 2, 1, 3)


def test_ties_have_one_outcome(spark):
    df = spark.createDataFrame([("a", "k", f"v{i}") for i in range(50)], "id string, k string, v string")
    chosen = {dedup_first(d, ["id"], ["k"]).first()["v"] for d in (df, df.orderBy("v"), df.orderBy(F.desc("v")), df.repartition(7))}
    assert len(chosen) == 1
