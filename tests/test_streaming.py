"""Resume, replay and failure of incremental and streaming copies."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from spanferry.functions.payload import REFERENCE_TAG
from spanferry.operators.payload import finish_rows
from spanferry.queries import copies
from spanferry.sources import state
from spanferry.streaming import increments, replicate

COLUMNS = "id string, _pagination_key string, created timestamp, _object_delete boolean, input string"


@pytest.fixture
def paths(tmp_path):
    return {n: str(tmp_path / n) for n in ("source", "sink", "checkpoint", "metrics", "state_path")}


def rows(spark, *items):
    data = [(i, k, None, gone, text) for i, k, gone, text in items]
    return spark.createDataFrame(data, COLUMNS).withColumn("created", F.lit("2020-01-02").cast("timestamp"))


def add(spark, paths, *items):
    rows(spark, *items).coalesce(1).write.mode("append").parquet(paths["source"])


def run(spark, paths, shape=None, **options):
    where = {k: v for k, v in paths.items() if k not in ("source",)}
    schema = spark.createDataFrame([], COLUMNS).schema
    query = replicate.replicate_stream(
        spark, paths["source"], schema, stream="logs", key="_pagination_key", ids=["id"], shape=shape,
        tombstone=F.col("_object_delete"), size=F.octet_length("input"),
        limits=replicate.MicroBatchLimits(max_files=1), **where, **options,
    )
    query.awaitTermination()


def ids(spark, paths):
    return sorted(r["id"] for r in spark.read.parquet(paths["sink"]).collect())


def test_tombstones_and_later_versions(spark, paths):
    add(spark, paths, ("a", "p1", None, "xx"), ("d", "p1.5", True, "x"))
    add(spark, paths, ("a", "p2", None, "yyyy"), ("b", "p3", None, "zz"), ("b", "p4", None, "zz"))
    run(spark, paths)
    assert ids(spark, paths) == ["a", "b"]
    row = replicate.partial_results(spark, paths["metrics"]).first()
    assert (row["fetched"], row["inserted"], row["inserted_bytes"], row["skipped_deleted"], row["skipped_seen"]) == (5, 2, 4, 1, 2)
    progress = replicate.stream_progress(spark, paths["metrics"]).orderBy("batch_id").collect()
    assert [(r["fetched_total"], r["inserted_total"]) for r in progress] == [(2, 1), (5, 2)]
    # Nothing new: nothing is written again.
    run(spark, paths)
    assert ids(spark, paths) == ["a", "b"]


def test_failed_batch_is_retried_without_loss_or_copies(spark, paths):
    add(spark, paths, ("a", "p1", None, "ok"))
    add(spark, paths, ("b", "p2", None, "bad"), ("c", "p3", None, "ok"))

    def refuse(df):
        return df.withColumn("input", F.when(F.col("input") != "bad", F.col("input")).otherwise(F.raise_error(F.lit("refused")).cast("string")))

    with pytest.raises((StreamingQueryException, PySparkException)):
        run(spark, paths, refuse)
    assert ids(spark, paths) == ["a"]
    assert replicate.partial_results(spark, paths["metrics"]).first()["inserted"] == 1
    run(spark, paths)
    assert ids(spark, paths) == ["a", "b", "c"]
    assert replicate.partial_results(spark, paths["metrics"]).first()["inserted"] == 3


def test_replay_of_a_written_batch_overwrites_itself(spark, paths):
    batch = rows(spark, ("a", "p1", None, "x"), ("b", "p2", None, "y"))
    options = dict(
        sink=paths["sink"], metrics=paths["metrics"], stream="logs", key="_pagination_key", ids=["id"], tombstone=None, shape=None, size=None
    )
    replicate._commit(batch, 0, **options)
    # The metrics were lost with the driver; the engine hands over the same batch again.
    replicate._commit(batch, 0, **options)
    assert ids(spark, paths) == ["a", "b"]
    assert replicate.partial_results(spark, paths["metrics"]).first()["inserted"] == 2


def test_first_attempt_that_left_an_empty_folder(spark, paths, tmp_path):
    (tmp_path / "sink" / "_temporary").mkdir(parents=True)
    add(spark, paths, ("a", "p1", None, "x"))
    run(spark, paths)
    assert ids(spark, paths) == ["a"]


def test_filters_may_not_change(spark, paths):
    add(spark, paths, ("a", "p1", None, "x"))
    run(spark, paths, created_after="2020-01-01")
    for other in ({"created_after": "2020-01-02"}, {}, {"created_after": "2020-01-01", "created_before": ""}):
        with pytest.raises((ValueError, TypeError)):
            run(spark, paths, **other)
    # A bound the state did not have yet is adopted.
    run(spark, paths, created_after="2020-01-01", created_before="2021-01-01")
    with pytest.raises(ValueError, match="created_before"):
        run(spark, paths, created_after="2020-01-01")


def test_time_filter(spark, paths):
    add(spark, paths, ("a", "p1", None, "x"))
    run(spark, paths, created_after="2020-01-03")
    row = replicate.partial_results(spark, paths["metrics"]).first()
    assert (row["fetched"], row["inserted"]) == (0, 0)


def test_no_results_before_the_first_commit(spark, paths):
    assert replicate.partial_results(spark, paths["metrics"]).count() == 0
    row = state.read_state(spark, paths["state_path"], "logs").first()
    assert row["epoch"] == state.NO_EPOCH and row["last_key"] is None and row["fetched"] == 0


def test_one_limit_only():
    assert replicate.MicroBatchLimits(max_files=None, max_bytes=26_214_400).options() == {"maxBytesPerTrigger": "26214400"}
    with pytest.raises(ValueError):
        replicate.MicroBatchLimits(max_files=3, max_bytes=5).options()


def copy(df, paths, **options):
    return increments.copy_increment(
        df, paths["sink"], paths["state_path"], "logs", key="_pagination_key", ids=["id"], tombstone=F.col("_object_delete"),
        size=F.octet_length("input"), **options,
    ).first()


def test_increments_advance_after_the_write(spark, paths):
    first = rows(spark, ("a", "p1", None, "xx"), ("d", "p2", True, "x"), ("a", "p3", None, "y"))
    now = copy(first, paths)
    assert (now["epoch"], now["last_key"], now["fetched"], now["inserted"], now["inserted_bytes"], now["skipped_deleted"], now["skipped_seen"]) == (
        0, "p3", 3, 1, 2, 1, 1,
    )
    later = first.unionByName(rows(spark, ("a", "p4", None, "zz"), ("e", "p5", None, "e")))
    refuse = lambda df: df.withColumn("input", F.raise_error(F.lit("refused")).cast("string"))
    with pytest.raises(PySparkException):
        copy(later, paths, shape=refuse)
    assert state.read_state(spark, paths["state_path"], "logs").first()["last_key"] == "p3"
    now = copy(later, paths)
    assert (now["epoch"], now["last_key"], now["fetched"], now["inserted"], now["skipped_seen"]) == (1, "p5", 5, 2, 2)
    assert ids(spark, paths) == ["a", "e"]
    idle = copy(later, paths)
    assert (idle["last_key"], idle["fetched"], idle["inserted"]) == ("p5", 5, 2)


def test_increment_written_but_not_recorded_is_replaced(spark, paths):
    first = rows(spark, ("a", "p1", None, "x"))
    copy(first, paths)
    # The rows of epoch 1 reached the sink, the state did not.
    rows(spark, ("b", "p2", None, "y")).withColumn("epoch", F.lit(1)).write.mode("append").partitionBy("epoch").parquet(paths["sink"])
    copy(first.unionByName(rows(spark, ("b", "p2", None, "y"), ("c", "p3", None, "z"))), paths)
    assert ids(spark, paths) == ["a", "b", "c"]


def test_extract_after_state(spark, paths):
    df = rows(spark, ("a", "p1", None, "x"), ("b", "p2", None, "x"))
    at = spark.createDataFrame([("p1",)], "last_key string")
    assert [r["id"] for r in increments.extract_incremental(df, at, "_pagination_key").collect()] == ["b"]
    nowhere = spark.createDataFrame([(None,)], "last_key string")
    assert increments.extract_incremental(df, nowhere, "_pagination_key").count() == 2


@pytest.mark.parametrize("options", [{}, {"event_time": "created", "delay": "2 days"}])
def test_late_firsts_are_kept_and_late_copies_dropped(spark, paths, options):
    batches = [
        [("a", "2024-01-10"), ("b", "2024-01-10"), ("a", "2024-01-10")],
        [("a", "2024-01-11"), ("c", "2024-03-01")],
        [("late", "2023-01-01"), ("b", "2024-01-10"), (None, "2024-03-01"), ("c", "2024-02-29"), ("timeless", None)],
        [("late", "2023-01-01"), ("timeless", None), ("d", "2024-03-02")],
    ]
    if not options:
        batches.append([("a", "2025-01-01")])
    for batch in batches:
        made = spark.createDataFrame(batch, "id string, at string").select("id", F.col("at").cast("timestamp").alias("created"))
        made.coalesce(1).write.mode("append").parquet(paths["source"])
        schema = made.schema
    for _ in range(2):
        events = replicate.read_events(spark, paths["source"], schema, replicate.MicroBatchLimits(max_files=1))
        replicate.dedup_stream(events, ["id"], ["created"], paths["sink"], paths["checkpoint"], **options).awaitTermination()
    got = spark.read.parquet(paths["sink"])
    assert sorted(str(r["id"]) for r in got.collect()) == ["None", "a", "b", "c", "d", "late", "timeless"]


def _reference(key):
    return json.dumps({"type": REFERENCE_TAG, "key": key, "filename": "f", "content_type": "t"})


def _finish(spark):
    copies = spark.createDataFrame([("k1", "K1", "f", "t")], "source_key string, dest_key string, filename string, content_type string")
    return dict(ref_map=copies, payload="input", max_row_bytes=1000, min_field_bytes=300)


def _finished(spark, paths, counted):
    stored = {r["id"]: r["input"] for r in spark.read.parquet(paths["sink"]).collect()}
    side = {r["event_id"]: (r["key"], r["payload"]) for r in spark.read.parquet(paths["sink"] + "_side").collect()}
    assert json.loads(stored["ref"])["key"] == "K1" and stored["small"] == "x"
    assert set(side) == {"big"} and side["big"] == (json.loads(stored["big"])["key"], "y" * 2000)
    assert (counted["fetched"], counted["inserted"], counted["attachments_copied"], counted["spilled_fields"]) == (3, 3, 1, 1)


def test_increments_rewrite_and_spill(spark, paths):
    df = rows(spark, ("ref", "p1", None, _reference("k1")), ("big", "p2", None, "y" * 2000), ("small", "p3", None, "x"))
    _finished(spark, paths, copy(df, paths, **_finish(spark)))


def test_streams_rewrite_and_spill(spark, paths):
    add(spark, paths, ("ref", "p1", None, _reference("k1")))
    add(spark, paths, ("big", "p2", None, "y" * 2000), ("small", "p3", None, "x"))
    run(spark, paths, **_finish(spark))
    _finished(spark, paths, replicate.partial_results(spark, paths["metrics"]).first())


def test_arrays_count_towards_the_cap(spark):
    df = spark.createDataFrame([("a", "i" * 400, ["t" * 100] * 10), ("b", "i" * 400, ["t"])], "id string, input string, tags array<string>")
    done = finish_rows(df, "id", "s", max_row_bytes=1200, min_field_bytes=100)
    assert {r["id"]: r["spilled_fields"] for r in done.rows.collect()} == {"a": 1, "b": 0}
    b = done.rows.where("id = 'b'").first()
    assert b["row_bytes"] == len(json.dumps({"id": "b", "input": "i" * 400, "tags": ["t"]}, separators=(",", ":")))


def test_arrivals_are_written_by_as_many_tasks_as_their_size_needs(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), F.lit(450)), F.col("id").cast("string")).alias("text")).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    monkeypatch.setattr(copies, "_ARRIVAL_BYTES", 4_000)
    made = []
    monkeypatch.setattr(copies, "scratch_path", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
    found = copies.replicate_stream_spilled(spark, str(tmp_path)).first()
    assert (found["fetched"], found["inserted"] + found["quarantined"]) == (40, 40)
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) > 4
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 4
