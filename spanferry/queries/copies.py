"""Resumable, routed and streaming copies, and the composed event and object copies."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from spanferry.functions.payload import json_bytes
from spanferry.operators import dedup, project
from spanferry.operators.report import status_rollup
from spanferry.plans import event_copy, object_copy
from spanferry.queries.registry import query, table
from spanferry.shared import scratch_path
from spanferry.sources import sinks, state
from spanferry.streaming import increments, replicate

_SPLITS = ("2024-01-10", "2024-01-20")


def _ts(value):
    return F.lit(value).cast("timestamp_ntz")


@query(
    "extract_incremental",
    "SELECT event_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS epoch FROM events",
)
def extract_incremental(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sink, states = scratch_path(spark, "sink"), scratch_path(spark, "state")
    for available in (events.where(F.col("ts") < _ts("2024-01-15")), events):
        increments.copy_increment(available, sink, states, "events", key="event_id", ids=["event_id"])
    return spark.read.parquet(sink).select("event_id", "event_type", "epoch")


@query(
    "write_state",
    """SELECT event_type AS stream, 1::BIGINT AS epoch, max(event_id)::VARCHAR AS last_key, count(*) AS fetched,
              count(*) FILTER (value <= 90) AS inserted, count(*) FILTER (value > 90) AS skipped_deleted FROM events GROUP BY 1""",
)
def write_state(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "state")
    for epoch, seen in ((0, events.where(F.col("ts") < _ts("2024-01-15"))), (1, events)):
        counted = seen.groupBy(F.col("event_type").alias("stream")).agg(
            F.max("event_id").cast("string").alias("last_key"), F.count(F.lit(1)).alias("fetched"),
            F.count_if(F.col("value") <= 90).alias("inserted"), F.count_if(F.col("value") > 90).alias("skipped_deleted"),
        )
        state.write_state(counted.withColumn("epoch", F.lit(epoch)), path)
    return state.latest_states(spark, path).select("stream", "epoch", "last_key", "fetched", "inserted", "skipped_deleted")


_ROUTED_SQL = """SELECT l_suppkey + 1000000 AS dest, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, min(l_suppkey) AS l_suppkey
       FROM lineitem GROUP BY 1"""


@query("write_routed_twice", _ROUTED_SQL)
def write_routed_twice(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    routes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") + 1000000).alias("dest_id")
    )
    path = scratch_path(spark, "routed")
    early, late = items.where("l_linenumber <= 2"), items.where("l_linenumber > 2")
    # The second run follows the first; its repeated attempt replaces what the attempt before it wrote.
    for part, run in ((early, "first"), (late, "second"), (late, "second")):
        sinks.write_routed(part, routes, "l_suppkey", "dest", path, ["l_orderkey"], run=run)
    return spark.read.parquet(path).groupBy(F.col("dest").cast("bigint").alias("dest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.min("l_suppkey").alias("l_suppkey")
    )


@query("write_routed", _ROUTED_SQL)
def write_routed(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    routes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") + 1000000).alias("dest_id")
    )
    path = scratch_path(spark, "routed")
    sinks.write_routed(items, routes, "l_suppkey", "dest", path, ["l_orderkey"])
    return spark.read.parquet(path).groupBy(F.col("dest").cast("bigint").alias("dest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.min("l_suppkey").alias("l_suppkey")
    )


def _event_files(spark, sf_dir):
    """Events as they would arrive: three time slices, then the middle slice once more."""
    path = scratch_path(spark, "arrivals")
    events = table(spark, sf_dir, "events")
    first, second = (_ts(s) for s in _SPLITS)
    middle = events.where((F.col("ts") >= first) & (F.col("ts") < second))
    for part in (events.where(F.col("ts") < first), middle, events.where(F.col("ts") >= second), middle):
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


def _replicate(spark, sf_dir, shape=None, **options):
    source, schema = _event_files(spark, sf_dir)
    paths = {name: scratch_path(spark, name) for name in ("sink", "checkpoint", "metrics", "state_path")}
    running = replicate.replicate_stream(
        spark, source, schema, stream="events", key="event_id", ids=["event_id"],
        tombstone=F.col("event_type") == "error", shape=shape, size=json_bytes(F.col("props")), created_col="ts",
        limits=replicate.MicroBatchLimits(max_files=1), **paths, **options,
    )
    return running, paths, source, schema


@query("replicate_stream", "SELECT event_id, user_id, event_type, props FROM events WHERE event_type <> 'error'")
def replicate_stream(spark, sf_dir):
    running, paths, *_ = _replicate(spark, sf_dir)
    running.awaitTermination()
    return spark.read.parquet(paths["sink"]).select("event_id", "user_id", "event_type", "props")


_TWICE = """(SELECT * FROM events UNION ALL SELECT * FROM events
             WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')"""


@query(
    "stream_progress",
    f"""SELECT 'events' AS stream, 4 AS batches, count(*) AS fetched_total,
               count(DISTINCT event_id) FILTER (event_type <> 'error') AS inserted_total,
               (SELECT sum(octet_length(encode(props)))::BIGINT FROM events WHERE event_type <> 'error') AS inserted_bytes_total,
               count(*) FILTER (event_type = 'error') AS skipped_deleted_total,
               count(*) FILTER (event_type <> 'error') - count(DISTINCT event_id) FILTER (event_type <> 'error') AS skipped_seen_total
        FROM {_TWICE}""",
)
def stream_progress(spark, sf_dir):
    running, paths, *_ = _replicate(spark, sf_dir)
    running.awaitTermination()
    progress = replicate.stream_progress(spark, paths["metrics"])
    # The events table holds no references and no fields to move; its SQL has the other five counters.
    totals = [f"{c}_total" for c in ("fetched", "inserted", "inserted_bytes", "skipped_deleted", "skipped_seen")]
    return progress.groupBy("stream").agg(
        F.count(F.lit(1)).cast("int").alias("batches"), *[F.max(c).alias(c) for c in totals]
    )


@query(
    "partial_results",
    """SELECT 'events' AS stream, count(*) AS fetched, count(*) FILTER (event_type <> 'error') AS inserted,
              count(*) FILTER (event_type = 'error') AS skipped_deleted, max(event_id)::VARCHAR AS last_key
       FROM events WHERE ts < TIMESTAMP '2024-01-20'""",
)
def partial_results(spark, sf_dir):
    def fail_late(df):
        late = F.raise_error(F.lit("the destination refused the row")).cast("string")
        return df.withColumn("props", F.when(F.col("ts") < _ts(_SPLITS[1]), F.col("props")).otherwise(late))

    running, paths, *_ = _replicate(spark, sf_dir, shape=fail_late)
    try:
        running.awaitTermination()
    except StreamingQueryException:
        pass
    done = replicate.partial_results(spark, paths["metrics"])
    return done.select("stream", "fetched", "inserted", "skipped_deleted", "last_key")


@query(
    "resume_after_failure",
    "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
)
def resume_after_failure(spark, sf_dir):
    def fail_late(df):
        late = F.raise_error(F.lit("the destination refused the row")).cast("string")
        return df.withColumn("props", F.when(F.col("ts") < _ts(_SPLITS[1]), F.col("props")).otherwise(late))

    running, paths, source, schema = _replicate(spark, sf_dir, shape=fail_late)
    try:
        running.awaitTermination()
    except StreamingQueryException:
        pass
    replicate.replicate_stream(
        spark, source, schema, stream="events", key="event_id", ids=["event_id"], tombstone=F.col("event_type") == "error",
        size=json_bytes(F.col("props")), created_col="ts", limits=replicate.MicroBatchLimits(max_files=1), **paths,
    ).awaitTermination()
    return spark.read.parquet(paths["sink"]).select("event_id", "event_type")


@query(
    "guard_filters",
    """SELECT 'changed' AS run, true AS refused, count(*) AS copied FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10'
       UNION ALL SELECT 'missing', true, count(*) FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10'
       UNION ALL SELECT 'same', false, count(*) FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10'""",
)
def guard_filters(spark, sf_dir):
    running, paths, *_ = _replicate(spark, sf_dir, created_after="2024-01-10")
    running.awaitTermination()
    stored = state.read_state(spark, paths["state_path"], "events")
    outcomes = []
    for run, after in (("changed", "2024-01-11"), ("missing", None), ("same", "2024-01-10")):
        try:
            state.guard_filters(stored, after, None)
            outcomes.append((run, False))
        except ValueError:
            outcomes.append((run, True))
    copied = spark.read.parquet(paths["sink"]).agg(F.count(F.lit(1)).alias("copied"))
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(o).alias("refused")) for r, o in outcomes]))
    return copied.select(named.alias("o"), "copied").select("o.run", "o.refused", "copied")


@query("dedup_stream", "SELECT event_id, user_id, event_type FROM events")
def dedup_stream(spark, sf_dir):
    source, schema = _event_files(spark, sf_dir)
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "checkpoint")
    # Four micro-batches; the last holds copies of rows of the second.
    arriving = replicate.read_events(spark, source, schema, replicate.MicroBatchLimits(max_files=1))
    replicate.dedup_stream(arriving, ["event_id"], ["ts"], sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


_EVENT_NAMES = {"event_id": "id", "ts": "created", "props": "metadata", "value": "_score", "user_id": "experiment_id"}


def _experiment_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns(
        {
            "event_id": F.col("event_id").cast("string"),
            "user_id": F.concat(F.lit("exp-"), F.col("user_id").cast("string")),
            "_object_delete": F.when(F.col("event_type") == "error", True),
            "_pagination_key": F.lpad(F.col("event_id").cast("string"), 12, "0"),
            "_xact_id": (F.col("event_id") + 7).cast("string"),
        }
    )
    return project.rename_columns(events, _EVENT_NAMES)


@query(
    "staged_copy",
    """SELECT event_id::VARCHAR AS id, 'exp-' || user_id AS experiment_id, octet_length(encode(props))::INTEGER AS row_bytes
       FROM events WHERE event_type <> 'error' AND NOT (ts < TIMESTAMP '2024-01-05')""",
)
def staged_copy(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    loaded = events.where(F.col("created") < _ts("2024-01-05"))
    path = scratch_path(spark, "staged")
    event_copy.staged_copy(
        events,
        keep=lambda df: project.drop_tombstones(df, "_object_delete"),
        shape=lambda df: df.select("id", "experiment_id", "metadata"),
        unseen=lambda df: dedup.anti_seen(df, loaded, ["id"]),
        size=lambda df: df.withColumn("row_bytes", json_bytes(F.col("metadata"))),
        sink=lambda df: df.write.mode("overwrite").parquet(path),
    )
    return spark.read.parquet(path).select("id", "experiment_id", "row_bytes")


# The row as it is sent: its metadata are JSON already.
_ROW_JSON = """'{"id":"' || event_id || '","created":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","experiment_id":"exp-' || user_id
              || '","metadata":' || props || ',"origin":{"object_type":"experiment","object_id":"exp-' || user_id || '","id":"' || event_id
              || '","_xact_id":"' || (event_id + 7) || '","created":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"}}'"""


@query(
    "copy_events",
    f"""SELECT event_id::VARCHAR AS id, 'exp-' || user_id AS experiment_id, 'experiment' AS object_type, 'exp-' || user_id AS object_id,
              event_id::VARCHAR AS origin_id, (event_id + 7)::VARCHAR AS xact_id, 0 AS spilled_fields,
              octet_length(encode({_ROW_JSON}))::BIGINT AS row_bytes
       FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-05'""",
)
def copy_events(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    copied = event_copy.copy_events(events.unionByName(events), "experiments", created_after="2024-01-05")
    return copied.rows.select(
        "id", "experiment_id", "origin.object_type", "origin.object_id", F.col("origin.id").alias("origin_id"),
        F.col("origin._xact_id").alias("xact_id"), "spilled_fields", "row_bytes",
    )


@query(
    "copy_events_counters",
    f"""SELECT 2 * count(*) AS fetched, count(*) FILTER (event_type <> 'error') AS inserted,
              (sum(octet_length(encode({_ROW_JSON}))) FILTER (event_type <> 'error'))::BIGINT AS inserted_bytes,
              2 * count(*) FILTER (event_type = 'error') AS skipped_deleted, count(*) FILTER (event_type <> 'error') AS skipped_seen,
              0::BIGINT AS attachments_copied, 0::BIGINT AS spilled_fields
       FROM events WHERE ts >= TIMESTAMP '2024-01-05'""",
)
def copy_events_counters(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    return event_copy.copy_events(events.unionByName(events), "experiments", created_after="2024-01-05").counters().drop("quarantined")


@query(
    "write_event_copy",
    """SELECT 'dest-' || user_id AS experiment_id, count(*) AS events, min(octet_length(encode(props)))::INTEGER AS least,
              max('exp-' || user_id) AS came_from FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def write_event_copy(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    id_map = events.select(F.col("experiment_id").alias("source_id")).distinct().select(
        F.lit("experiment").alias("resource_type"), "source_id", F.replace("source_id", F.lit("exp-"), F.lit("dest-")).alias("dest_id")
    )
    copied = event_copy.copy_events(events, "experiments")
    written = event_copy.write_event_copy(copied, "experiments", id_map, scratch_path(spark, "events"))
    return written.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("events"), F.min(F.octet_length("metadata")).alias("least"), F.max("origin.object_id").alias("came_from")
    )


@query(
    "write_event_copy_resumed",
    """SELECT 'dest-' || user_id AS experiment_id, count(*) AS events, count(*) AS moved, sum(octet_length(encode(props)))::BIGINT AS moved_bytes
       FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def write_event_copy_resumed(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    id_map = events.select(F.col("experiment_id").alias("source_id")).distinct().select(
        F.lit("experiment").alias("resource_type"), "source_id", F.replace("source_id", F.lit("exp-"), F.lit("dest-")).alias("dest_id")
    )
    path = scratch_path(spark, "events")
    target = None
    # Every payload moves to the side table; the second run meets the rows of the first in its target.
    for available in (events.where(F.col("created") < _ts("2024-01-15")), events):
        copied = event_copy.copy_events(available, "experiments", target=target, max_row_bytes=1, min_field_bytes=1, isolate_over=1_000)
        event_copy.write_event_copy(copied, "experiments", id_map, path)
        target = spark.read.parquet(path)
    rows = target.select("id", "experiment_id", F.get_json_object("metadata", "$.key").alias("key"))
    side = spark.read.parquet(f"{path}_side").select("key", F.octet_length("payload").alias("bytes"))
    return rows.join(side, "key", "left").groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("events"), F.count("bytes").alias("moved"), F.sum("bytes").cast("bigint").alias("moved_bytes")
    )


# Documents as rows: their text can be moved out of a row, the note of every third one cannot.
_NOTED_CAP, _NOTED_FIELD = 2_000, 600
_NOTED = f"""docs AS (
         SELECT doc_id, 'd' || doc_id AS id, lpad(doc_id::VARCHAR, 12, '0') AS k, text, CASE WHEN doc_id % 3 = 0 THEN repeat(text, 2) END AS note FROM documents),
       parts AS (
         SELECT *, '{{{{"id":"' || id || '","_pagination_key":"' || k || '"' || coalesce(',"note":' || to_json(note)::VARCHAR, '') AS head,
           octet_length(encode(',"input":' || CASE WHEN regexp_full_match(text, '(?s)\\{{{{.*\\}}}}|\\[.*\\]|".*"') THEN text ELSE to_json(text)::VARCHAR END)) AS held,
           octet_length(encode(',"input":{{{{"type":"stored_attachment","key":"' || repeat('0', 64) || '","filename":"input.json","content_type":"application/json"}}}}')) AS left_behind
         FROM docs),
       sized AS (SELECT *, octet_length(encode(head)) + 1 + held AS whole, octet_length(encode(text)) >= {_NOTED_FIELD} AS movable FROM parts),
       placed AS (
         SELECT *, whole > {_NOTED_CAP} AND movable AS moved, CASE WHEN whole > {_NOTED_CAP} AND movable THEN whole - held + left_behind ELSE whole END AS row_bytes
         FROM sized)""".replace("{{", "{").replace("}}", "}")


# Text in one file of those that arrive.
_ARRIVAL_BYTES = 128 * 1024 * 1024


def _noted_documents(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), number).alias("id"), F.lpad(number, 12, "0").alias("_pagination_key"), F.col("text").alias("input"),
        F.when(F.col("doc_id") % 3 == 0, F.repeat("text", F.lit(2))).alias("note"),
    )


_NOTED_TOTALS = f"""WITH {_NOTED}
       SELECT count(*) AS fetched, count(*) FILTER (row_bytes <= {_NOTED_CAP}) AS inserted,
              (sum(row_bytes) FILTER (row_bytes <= {_NOTED_CAP}))::BIGINT AS inserted_bytes,
              count(*) FILTER (moved AND row_bytes <= {_NOTED_CAP}) AS spilled_fields, count(*) FILTER (row_bytes > {_NOTED_CAP}) AS quarantined,
              count(*) FILTER (row_bytes > {_NOTED_CAP}) AS records, (sum(row_bytes) FILTER (row_bytes > {_NOTED_CAP}))::BIGINT AS record_bytes,
              count(*) FILTER (moved AND row_bytes <= {_NOTED_CAP}) AS side_rows,
              (sum(octet_length(encode(text))) FILTER (moved AND row_bytes <= {_NOTED_CAP}))::BIGINT AS side_bytes FROM placed"""


def _noted_totals(counters, oversize, side):
    records = oversize.agg(F.count(F.lit(1)).alias("records"), F.sum("approx_size").alias("record_bytes"))
    moved = side.agg(F.count(F.lit(1)).alias("side_rows"), F.sum(F.octet_length("payload")).cast("bigint").alias("side_bytes"))
    # One row each.
    kept = counters.select("fetched", "inserted", "inserted_bytes", "spilled_fields", "quarantined", F.lit(0).alias("_one"))
    return kept.join(records.withColumn("_one", F.lit(0)), "_one").join(moved.withColumn("_one", F.lit(0)), "_one").drop("_one")


@query("increment_spilled", _NOTED_TOTALS)
def increment_spilled(spark, sf_dir):
    sink = scratch_path(spark, "sink")
    docs = _noted_documents(spark, sf_dir)
    last = docs.agg(F.max("_pagination_key").alias("k")).first()["k"]
    half = str(int(last) // 2).zfill(12)
    states = scratch_path(spark, "state")
    for available in (docs.where(F.col("_pagination_key") <= half), docs):
        done = increments.copy_increment(
            available, sink, states, "docs", key="_pagination_key", ids=["id"], max_row_bytes=_NOTED_CAP, min_field_bytes=_NOTED_FIELD
        )
    return _noted_totals(done, spark.read.parquet(f"{sink}_quarantine"), spark.read.parquet(f"{sink}_side"))


@query("replicate_stream_spilled", _NOTED_TOTALS)
def replicate_stream_spilled(spark, sf_dir):
    source = scratch_path(spark, "arrivals")
    docs = _noted_documents(spark, sf_dir).withColumn("created", F.lit(None).cast("timestamp"))
    # Four micro-batches, each of as many files as keep a file's writer small.
    total = docs.agg(F.sum(F.coalesce(F.octet_length("input"), F.lit(0)) + F.coalesce(F.octet_length("note"), F.lit(0))).alias("b")).first()["b"]
    files = max(1, -(-(total or 0) // (4 * _ARRIVAL_BYTES)))
    docs.repartitionByRange(4 * files, "_pagination_key").write.parquet(source)
    paths = {name: scratch_path(spark, name) for name in ("sink", "checkpoint", "metrics", "state_path")}
    replicate.replicate_stream(
        spark, source, docs.schema, stream="docs", key="_pagination_key", ids=["id"], limits=replicate.MicroBatchLimits(max_files=files),
        shape=lambda df: df.drop("created"), max_row_bytes=_NOTED_CAP, min_field_bytes=_NOTED_FIELD, **paths,
    ).awaitTermination()
    counters = replicate.partial_results(spark, paths["metrics"])
    return _noted_totals(counters, spark.read.parquet(f"{paths['sink']}_quarantine"), spark.read.parquet(f"{paths['sink']}_side"))


@query(
    "copy_events_quarantined",
    f"""SELECT count(*) AS fetched, count(*) FILTER (event_type <> 'error' AND octet_length(encode({_ROW_JSON})) <= 219) AS inserted,
              count(*) FILTER (event_type = 'error') AS skipped_deleted, 0::BIGINT AS skipped_seen,
              count(*) FILTER (event_type <> 'error' AND octet_length(encode({_ROW_JSON})) > 219) AS quarantined,
              (sum(octet_length(encode({_ROW_JSON}))) FILTER (event_type <> 'error' AND octet_length(encode({_ROW_JSON})) > 219))::BIGINT AS isolated_bytes,
              (SELECT count(*) FROM events WHERE event_type <> 'error' AND octet_length(encode({_ROW_JSON})) <= 219) AS written
       FROM events""",
)
def copy_events_quarantined(spark, sf_dir):
    events = _experiment_events(spark, sf_dir)
    id_map = events.select(F.col("experiment_id").alias("source_id")).distinct().select(
        F.lit("experiment").alias("resource_type"), "source_id", F.replace("source_id", F.lit("exp-"), F.lit("dest-")).alias("dest_id")
    )
    path = scratch_path(spark, "events")
    # No field of these rows is large enough to be moved.
    copied = event_copy.copy_events(events, "experiments", max_row_bytes=219)
    written = event_copy.write_event_copy(copied, "experiments", id_map, path)
    # The schema is given: a copy without oversize rows leaves no file to take it from.
    isolated = spark.read.schema(copied.oversize.schema).parquet(f"{path}_quarantine").agg(F.sum("approx_size").alias("isolated_bytes"), F.lit(0).alias("_one"))
    counters = copied.counters(written).select("fetched", "inserted", "skipped_deleted", "skipped_seen", "quarantined", F.lit(0).alias("_one"))
    rows = written.agg(F.count(F.lit(1)).alias("written"), F.lit(0).alias("_one"))
    return counters.join(isolated, "_one").join(rows, "_one").drop("_one")


def _object_tables(spark, sf_dir):
    text = lambda name: F.col(name).cast("string")
    none = F.lit(None).cast("string")
    datasets = table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("p").alias("project_id"), none.alias("description"), "c_acctbal"
    )
    existing = datasets.where("c_acctbal < 0").select(F.concat(F.lit("there-"), "id").alias("id"), "name")
    experiments = table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("id"), F.concat(F.lit("order "), text("o_orderkey")).alias("name"), F.lit("p").alias("project_id"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") - 1).cast("string")).alias("base_exp_id"),
        text("o_custkey").alias("dataset_id"), none.alias("parameters_id"), F.lit("v1").alias("parameters_version"),
    )
    return {"dataset": datasets.drop("c_acctbal"), "experiment": experiments}, {"dataset": existing}


def _copy_objects(spark, sf_dir):
    sources, existing = _object_tables(spark, sf_dir)
    empty = spark.createDataFrame([], "resource_type string, source_id string, dest_id string")
    return object_copy.copy_objects(sources, existing, empty, object_copy.Scope(project_id="dest"), project="orders")


@query(
    "copy_objects",
    """SELECT sha256('experiment|dest|' || o_orderkey) AS id, o_orderkey::VARCHAR AS source_id, 'order ' || o_orderkey AS name, 'dest' AS project_id,
              CASE WHEN o_orderstatus = 'F' AND o_orderkey > 0 THEN sha256('experiment|dest|' || (o_orderkey - 1)) END AS base_exp_id,
              CASE WHEN c_acctbal < 0 THEN 'there-' || c_custkey ELSE sha256('dataset|dest|' || c_custkey) END AS dataset_id,
              NULL::VARCHAR AS parameters_id, NULL::VARCHAR AS parameters_version
       FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def copy_objects(spark, sf_dir):
    copies, _, _ = _copy_objects(spark, sf_dir)
    return copies["experiment"].create


@query(
    "copy_objects_report",
    """WITH r AS (SELECT 'dataset' AS resource_type, c_acctbal < 0 AS skipped FROM customer
                  UNION ALL SELECT 'experiment', false FROM orders)
       SELECT CASE WHEN grouping(p) = 0 THEN p END AS project, CASE WHEN grouping(resource_type) = 0 THEN resource_type END AS resource_type,
              grouping(p, resource_type)::INTEGER AS level, count(*) AS total, count(*) FILTER (NOT skipped) AS migrated,
              count(*) FILTER (skipped) AS skipped, 0::BIGINT AS failed
       FROM (SELECT 'orders' AS p, * FROM r) GROUP BY ROLLUP (p, resource_type)""",
)
def copy_objects_report(spark, sf_dir):
    _, results, _ = _copy_objects(spark, sf_dir)
    return status_rollup(results)
