"""Checkpointed stream copy with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from spanferry.operators.dedup import anti_seen, dedup_first
from spanferry.operators.payload import MAX_ROW_BYTES, MIN_SPILL_BYTES
from spanferry.operators.project import created_between, drop_tombstones
from spanferry.shared import read_stored, stored_keys
from spanferry.sources.state import NO_EPOCH, STATE_SCHEMA, guard_filters, read_state, write_state
from spanferry.streaming.batches import write_batch


@dataclass(frozen=True)
class MicroBatchLimits:
    """Bound of one commit: a number of files or of bytes, not both."""

    max_files: int | None = 16
    max_bytes: int | None = None

    def options(self) -> dict[str, str]:
        if (self.max_files is None) == (self.max_bytes is None):
            raise ValueError("set exactly one of max_files and max_bytes")
        if self.max_files is not None:
            return {"maxFilesPerTrigger": str(int(self.max_files))}
        return {"maxBytesPerTrigger": str(int(self.max_bytes))}


METRICS_SCHEMA = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("last_key", T.StringType()),
        *[
            T.StructField(c, T.LongType())
            for c in (
                "fetched", "inserted", "inserted_bytes", "skipped_deleted", "skipped_seen", "attachments_copied", "spilled_fields",
                "quarantined",
            )
        ],
    ]
)


def read_events(spark: SparkSession, source: str, schema: T.StructType, limits: MicroBatchLimits) -> DataFrame:
    """Files of a folder as a stream with bounded micro-batches."""
    return spark.readStream.schema(schema).options(**limits.options()).parquet(source)


def dedup_within_watermark(df: DataFrame, ids: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Bounded state without a sink. Rows behind the watermark are lost, seen or not: see :func:`dedup_stream`."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(ids))


def dedup_stream(
    events: DataFrame,
    ids: Sequence[str],
    order_by: Sequence[str],
    sink: str,
    checkpoint: str,
    *,
    event_time: str | None = None,
    delay: str | None = None,
) -> StreamingQuery:
    """Write the first version of each id, whatever its event time, to ``batch_id=<n>`` of the sink, and stop.

    Ids are checked against the earlier batches of the sink, so neither late rows nor late copies are
    lost or kept twice. With ``event_time`` and ``delay`` (an interval such as ``40 days``), for streams whose copies have event
    times within ``delay`` of the first, a row is only checked against stored rows that recent; rows
    behind the watermark or without a time are still checked against the whole sink.
    """
    if (event_time is None) != (delay is None):
        raise ValueError("event_time and delay belong together")

    def commit(batch: DataFrame, batch_id: int) -> None:
        names = [*ids] if event_time is None or event_time in ids else [*ids, event_time]
        stored = stored_keys(batch, sink, names, "batch_id", batch_id)
        if stored is None:
            unseen = batch
        elif event_time is None:
            unseen = anti_seen(batch, stored, ids)
        else:
            span = F.expr(f"INTERVAL {delay}")
            watermark = F.lit(stored.agg((F.max(event_time) - span).alias("at")).first()["at"]).cast(batch.schema[event_time].dataType)
            on_time = F.coalesce(F.col(event_time) >= watermark, F.lit(False))
            recent = stored.where(F.col(event_time).isNull() | (F.col(event_time) >= watermark - span))
            unseen = anti_seen(batch.where(on_time), recent, ids).unionByName(anti_seen(batch.where(~on_time), stored, ids))
        (
            dedup_first(unseen, ids, order_by).withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(sink)
        )

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _commit(
    batch: DataFrame,
    batch_id: int,
    *,
    sink: str,
    metrics: str,
    stream: str,
    key: str,
    ids: Sequence[str],
    tombstone: Column | None,
    shape: Callable[[DataFrame], DataFrame] | None,
    size: Column | None,
    **finish: object,
) -> None:
    """Write one micro-batch to its own partition, then its counters.

    A replay sees the sink without its own partition and overwrites it, so a batch that failed halfway
    neither hides its rows from itself nor leaves them twice. ``finish`` goes to :func:`write_batch`.
    """
    spark = batch.sparkSession
    deleted = F.lit(0) if tombstone is None else F.count_if(tombstone.eqNullSafe(F.lit(True)))
    seen = batch.agg(
        F.count(F.lit(1)).alias("fetched"), deleted.alias("deleted"), F.max(key).cast("string").alias("last_key")
    ).first()
    live = batch if tombstone is None else drop_tombstones(batch, tombstone)
    stored = stored_keys(batch, sink, ids, "batch_id", batch_id)
    unseen = live if stored is None else anti_seen(live, stored, ids)
    fresh = dedup_first(unseen, ids, [key])
    shaped = fresh if shape is None else shape(fresh)
    inserted = write_batch(shaped, sink, "batch_id", batch_id, stream=stream, ids=ids, size=size, **finish)
    row = (
        stream,
        batch_id,
        seen["last_key"],
        seen["fetched"],
        inserted["inserted"],
        inserted["inserted_bytes"],
        seen["deleted"],
        seen["fetched"] - seen["deleted"] - inserted["inserted"] - inserted["quarantined"],
        inserted["attachments_copied"],
        inserted["spilled_fields"],
        inserted["quarantined"],
    )
    (
        spark.createDataFrame([row], METRICS_SCHEMA)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(metrics)
    )


def replicate_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    *,
    stream: str,
    key: str,
    ids: Sequence[str],
    metrics: str,
    state_path: str,
    tombstone: Column | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    size: Column | None = None,
    created_col: str = "created",
    created_after: str | None = None,
    created_before: str | None = None,
    limits: MicroBatchLimits = MicroBatchLimits(),
    ref_map: DataFrame | None = None,
    payload: str | None = None,
    side_path: str | None = None,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
) -> StreamingQuery:
    """Copy everything that is there and stop; run again to continue.

    The state table remembers the time filters, and a run with other filters is refused before it
    starts. The caller waits with ``awaitTermination()``, which raises when a batch failed.
    """
    state = read_state(spark, state_path, stream).first()
    guard_filters(state, created_after, created_before)
    filters = {"created_after": created_after, "created_before": created_before}
    if state["epoch"] == NO_EPOCH or any(state[k] != v for k, v in filters.items()):
        now = {**state.asDict(), "epoch": max(state["epoch"], 0), **filters}
        write_state(spark.createDataFrame([tuple(now[c] for c in STATE_SCHEMA.names)], STATE_SCHEMA), state_path)
    events = created_between(read_events(spark, source, schema, limits), created_col, created_after, created_before)

    def commit(batch: DataFrame, batch_id: int) -> None:
        _commit(
            batch, batch_id, sink=sink, metrics=metrics, stream=stream, key=key, ids=ids,
            tombstone=tombstone, shape=shape, size=size, ref_map=ref_map, payload=payload, side_path=side_path,
            max_row_bytes=max_row_bytes, min_field_bytes=min_field_bytes,
        )

    return (
        events.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_progress(spark: SparkSession, metrics: str) -> DataFrame:
    """Committed totals after each micro-batch, one row per batch.

    The running sums are over batches of a stream, of which there is one row each.
    """
    rows = spark.read.schema(METRICS_SCHEMA).parquet(metrics).select(*METRICS_SCHEMA.names)
    so_far = Window.partitionBy("stream").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"{c}_total": F.sum(F.coalesce(c, F.lit(0))).over(so_far) for c in METRICS_SCHEMA.names[3:]}
    return rows.withColumns(totals)


def partial_results(spark: SparkSession, metrics: str) -> DataFrame:
    """What was committed so far, whether or not the stream failed afterwards."""
    counters = METRICS_SCHEMA.names[3:]
    stored = read_stored(spark, metrics, METRICS_SCHEMA)
    rows = spark.createDataFrame([], METRICS_SCHEMA) if stored is None else stored
    return rows.groupBy("stream").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in counters], F.max_by("last_key", "batch_id").alias("last_key")
    )
