"""Resumable extraction in batch form: each run copies what lies after the last committed key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.operators.dedup import anti_seen, dedup_first_wide
from spanferry.operators.payload import MAX_ROW_BYTES, MIN_SPILL_BYTES
from spanferry.operators.project import drop_tombstones
from spanferry.operators.resolve import is_set
from spanferry.operators.scan import keyset_range
from spanferry.shared import stored_keys
from spanferry.sources.state import STATE_SCHEMA, guard_filters, read_state, write_state
from spanferry.streaming.batches import write_batch


def extract_incremental(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows after the last committed key of a one-row state, and all rows without a key, which no state can pass."""
    row = state.select("last_key").first()
    return _open_rows(df, key, row["last_key"] if row is not None else None)


def _open_rows(df: DataFrame, key: str, last_key: str | None) -> DataFrame:
    if last_key in (None, ""):
        return df
    return df.where((F.col(key) > F.lit(last_key).cast(df.schema[key].dataType)) | F.col(key).isNull())


def copy_increment(
    df: DataFrame,
    sink: str,
    state_path: str,
    stream: str,
    *,
    key: str,
    ids: Sequence[str],
    tombstone: Column | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    size: Column | None = None,
    created_col: str = "created",
    created_after: str | None = None,
    created_before: str | None = None,
    ref_map: DataFrame | None = None,
    payload: str | None = None,
    side_path: str | None = None,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
) -> DataFrame:
    """Copy one increment and return the new state row.

    The increment ends at the largest key seen when it starts. Its rows go to ``epoch=<n>`` of the
    sink; the state advances only afterwards. A run that dies in between leaves the state as it was,
    and the next run replaces the same epoch, so rows are neither lost nor written twice. References, oversize
    fields and their side table are as in :func:`write_batch`.

    Rows without a key belong to every increment and are told apart by id: one that was written counts as seen. A row with
    neither key nor id could be written again each time, so it is refused with ``ValueError`` before anything is written.
    """
    spark = df.sparkSession
    before = read_state(spark, state_path, stream).first()
    guard_filters(before, created_after, created_before)
    epoch = before["epoch"] + 1
    after = _open_rows(keyset_range(df, key, None, False, created_col, created_after, created_before), key, before["last_key"])
    nameless = F.col(key).isNull()
    for name in ids:
        nameless = nameless & ~is_set(df, name)
    deleted = F.lit(0) if tombstone is None else F.count_if(tombstone.eqNullSafe(F.lit(True)))
    seen = after.agg(
        F.max(key).alias("high"), F.count(F.lit(1)).alias("fetched"), deleted.alias("deleted"), F.count_if(nameless).alias("nameless")
    ).first()
    if seen["nameless"]:
        raise ValueError(f"{seen['nameless']} rows have neither {key} nor {', '.join(ids)}")
    high = seen["high"]
    rows = after if high is None else after.where((F.col(key) <= F.lit(high)) | F.col(key).isNull())
    live = rows if tombstone is None else drop_tombstones(rows, tombstone)
    # Stored ids are dropped first: that needs no shuffle for a small increment and measures plain scans.
    stored = stored_keys(df, sink, ids, "epoch", epoch)
    unseen = live if stored is None else anti_seen(live, stored, ids)
    fresh = dedup_first_wide(unseen, ids, [key])
    shaped = fresh if shape is None else shape(fresh)
    inserted = write_batch(
        shaped, sink, "epoch", epoch, stream=stream, ids=ids, size=size, ref_map=ref_map, payload=payload,
        side_path=side_path, max_row_bytes=max_row_bytes, min_field_bytes=min_field_bytes,
    )
    totals = {
        "fetched": seen["fetched"],
        **inserted,
        "skipped_deleted": seen["deleted"],
        "skipped_seen": seen["fetched"] - seen["deleted"] - inserted["inserted"] - inserted["quarantined"],
    }
    now = {
        **before.asDict(),
        "epoch": epoch,
        "last_key": before["last_key"] if high is None else str(high),
        "created_after": created_after,
        "created_before": created_before,
        **{name: (before[name] or 0) + value for name, value in totals.items()},
    }
    write_state(spark.createDataFrame([tuple(now[c] for c in STATE_SCHEMA.names)], STATE_SCHEMA), state_path)
    return read_state(spark, state_path, stream)
