"""Event copy: from a source table to rows ready for the destination, with counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.operators.dedup import anti_seen, dedup_first_wide
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits
from spanferry.operators.payload import (
    MAX_ROW_BYTES,
    MIN_SPILL_BYTES,
    SPILLABLE_FIELDS,
    finish_rows,
)
from spanferry.operators.project import (
    ORIGIN_TYPES,
    PROJECT_LOGS_LOG_ID,
    created_between,
    drop_tombstones,
    event_insert_projection,
    require_object_id,
    stamp_destination,
    stamp_origin,
)
from spanferry.sources.sinks import RUN_COLUMN, new_run, quarantine, read_run, write_routed, write_run

Stage = Callable[[DataFrame], DataFrame]

# The column that names the owning object of an event, and the kind of that object.
OWNER_COLUMNS = {"logs": "project_id", "experiments": "experiment_id", "datasets": "dataset_id"}
OWNER_KINDS = {"logs": "project", "experiments": "experiment", "datasets": "dataset"}


def staged_copy(
    df: DataFrame,
    *,
    keep: Stage | None = None,
    shape: Stage | None = None,
    unseen: Stage | None = None,
    rewrite: Stage | None = None,
    size: Stage | None = None,
    spill: Stage | None = None,
    sink: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Run caller-supplied stages in their fixed order: keep, shape, unseen, rewrite, size, spill, sink.

    Every stage is a DataFrame function, so the whole chain is one plan. Row-level code belongs in a
    pandas UDF inside a stage.
    """
    for stage in (keep, shape, unseen, rewrite, size, spill):
        if stage is not None:
            df = df.transform(stage)
    if sink is not None:
        sink(df)
    return df


@dataclass(frozen=True)
class EventCopy:
    """Rows to write, the side table of moved field values, a record of each row too large to write, and their source."""

    rows: DataFrame
    side: DataFrame
    fetched: DataFrame
    deleted: Column | None
    oversize: DataFrame

    def counters(self, written: DataFrame | None = None) -> DataFrame:
        """One row of counters. Pass the rows read back from the sink, so that the copy is not run again."""
        return copy_counters(self.fetched, self.rows if written is None else written, self.deleted, oversize=self.oversize)


def write_event_copy(
    copy: EventCopy,
    kind: str,
    id_map: DataFrame,
    path: str,
    order_by: Sequence[str] = ("id",),
    limits: JoinLimits = DEFAULT_LIMITS,
    side_path: str | None = None,
    run: str | None = None,
) -> DataFrame:
    """Write the rows of any number of source objects, each under its destination, and read this run's rows back.

    One scan serves all objects: the owner column becomes the destination id and, unless there are very many, names the folder. An
    event whose owner has no destination fails the job. Values moved out of the rows are stored first, in
    ``side_path`` (by default ``<path>_side``), and records of rows too large for the destination in ``<path>_quarantine``.
    Rows of earlier runs stay; the same ``run`` replaces its own.
    """
    owner = OWNER_COLUMNS[kind]
    run = run or new_run()
    routes = id_map.where(F.col("resource_type") == OWNER_KINDS[kind]).select("source_id", "dest_id")
    rows = stamp_destination(copy.rows, log_id=PROJECT_LOGS_LOG_ID) if kind == "logs" else copy.rows
    write_run(copy.side.withColumn(RUN_COLUMN, F.lit(run)).write, side_path or f"{path.rstrip('/')}_side")
    write_run(copy.oversize.withColumn(RUN_COLUMN, F.lit(run)).write, f"{path.rstrip('/')}_quarantine")
    write_routed(rows, routes, owner, owner, path, order_by, limits, run)
    return read_run(rows.sparkSession, path, rows.schema, run)


def copy_counters(
    fetched: DataFrame, inserted: DataFrame, deleted: Column | None = None, keys: Sequence[str] = (), oversize: DataFrame | None = None
) -> DataFrame:
    """Counters of a copy per key: what was fetched, what was written, and why the rest was not.

    The inputs are reduced to a row per key before they meet. ``inserted`` may carry ``row_bytes``,
    ``attachments_copied`` and ``spilled_fields``. ``oversize`` holds the rows isolated for their size, with the same keys; with
    it the counters gain ``quarantined``, and ``fetched = inserted + skipped_deleted + skipped_seen + quarantined``.
    """
    is_deleted = F.lit(False) if deleted is None else deleted.eqNullSafe(F.lit(True))
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        fetched, inserted = (d.withColumn("_all", F.lit(0)) for d in (fetched, inserted))
        oversize = None if oversize is None else oversize.withColumn("_all", F.lit(0))
    came = fetched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(is_deleted).alias("skipped_deleted")
    )

    def total(col: str) -> Column:
        return F.sum(F.col(col).cast("long")) if col in inserted.columns else F.lit(0).cast("long")

    went = inserted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inserted"),
        total("row_bytes").alias("inserted_bytes"),
        total("attachments_copied").alias("attachments_copied"),
        total("spilled_fields").alias("spilled_fields"),
    )
    went_columns = ("inserted", "inserted_bytes", "attachments_copied", "spilled_fields")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    met = came.alias("c").join(went.alias("w"), same, "left").select("c.*", *[f"w.{c}" for c in went_columns])
    joined = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in went_columns})
    isolated = F.lit(0).cast("long")
    if oversize is not None:
        large = oversize.groupBy(*keys).agg(F.count(F.lit(1)).alias("quarantined"))
        same = [F.col(f"j.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
        joined = joined.alias("j").join(large.alias("q"), same, "left").select("j.*", "q.quarantined")
        isolated = F.coalesce("quarantined", F.lit(0))
    counted = joined.withColumn(
        "skipped_seen", F.col("fetched") - F.col("skipped_deleted") - F.col("inserted") - isolated
    )
    return counted.select(
        *[k for k in keys if k != "_all"],
        "fetched", "inserted", "inserted_bytes", "skipped_deleted", "skipped_seen", "attachments_copied", "spilled_fields",
        *([] if oversize is None else [isolated.alias("quarantined")]),
    )


def copy_events(
    df: DataFrame,
    kind: str,
    *,
    key: str = "_pagination_key",
    created_after: object | None = None,
    created_before: object | None = None,
    target: DataFrame | None = None,
    ref_map: DataFrame | None = None,
    payload: str | None = None,
    schema_columns: Sequence[str] | None = None,
    stream: str | None = None,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
    isolate_over: int | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> EventCopy:
    """Shape events of ``kind`` (``logs``, ``experiments``, ``datasets``) for insertion.

    Time range; tombstones (not for logs, which carry them over); first version of each id; rows
    already in ``target``; allow-list and provenance; attachment references in ``payload`` when a
    ``ref_map`` is given; oversize fields; rows then still over ``isolate_over``, the destination's own limit (by default the cap
    ``max_row_bytes``), go to ``oversize``, not to ``rows``. The owning object column stays, for routing. Rows that tie in ``key`` are told apart by content, so all three tables hold the same versions
    however often they are evaluated.
    """
    owner = OWNER_COLUMNS[kind]
    ranged = created_between(df, "created", created_after, created_before)
    if kind != "logs":
        ranged = require_object_id(ranged, owner)
    deleted = None if kind == "logs" or "_object_delete" not in df.columns else F.col("_object_delete")
    live = ranged if deleted is None else drop_tombstones(ranged, deleted)
    unseen = live if target is None else anti_seen(live, target, ["id"], limits)
    fresh = dedup_first_wide(unseen, ["id"], [key], limits)
    stamped = stamp_origin(fresh, ORIGIN_TYPES[kind], F.col(owner))
    allowed = set(event_insert_projection(stamped, kind, schema_columns).columns) | {owner, "origin"}
    shaped = stamped.select(*[c for c in stamped.columns if c in allowed])
    isolate_over = max_row_bytes if isolate_over is None else isolate_over
    finished = finish_rows(
        shaped, "id", stream or kind, ref_map, payload, SPILLABLE_FIELDS, max_row_bytes, min_field_bytes, limits, isolate_over
    )
    rows, oversize = quarantine(
        finished.rows, F.col("row_bytes"), isolate_over, stream or kind, F.lit(None), key_col=None,
        payloads=[f for f in SPILLABLE_FIELDS if f in shaped.columns], columns=shaped.columns,
    )
    return EventCopy(rows, finished.side, ranged, deleted, oversize)
