"""What every increment and micro-batch goes through after deduplication, and how it is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from spanferry.operators.payload import MAX_ROW_BYTES, MIN_SPILL_BYTES, SPILLABLE_FIELDS, finish_rows
from spanferry.shared import settle
from spanferry.sources.sinks import quarantine

WRITTEN = ("inserted", "inserted_bytes", "attachments_copied", "spilled_fields", "quarantined")


def _write_partition(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def write_batch(
    shaped: DataFrame,
    sink: str,
    name: str,
    number: int,
    *,
    stream: str,
    ids: Sequence[str],
    size: Column | None = None,
    ref_map: DataFrame | None = None,
    payload: str | None = None,
    side_path: str | None = None,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
) -> dict[str, int]:
    """Rewrite references, move oversize fields and write to ``<name>=<number>`` of the sink; the counters ``WRITTEN``.

    Moved values are stored first, in ``side_path`` (by default ``<sink>_side``). ``size`` is what ``inserted_bytes``
    sums, by default the row as JSON. Rows still over the cap are not written; ``<sink>_quarantine`` gets a record of each.
    Rows with fields that could be moved are settled, so all tables hold the same versions.
    """
    movable = any(f in shaped.columns for f in SPILLABLE_FIELDS)
    columns = shaped.columns
    done = finish_rows(
        settle(shaped) if movable else shaped, ids[0], stream, ref_map, payload,
        max_row_bytes=max_row_bytes, min_field_bytes=min_field_bytes,
    )
    if movable:
        _write_partition(done.side.withColumn(name, F.lit(number)), side_path or f"{sink.rstrip('/')}_side", name)

    fitting, oversize = quarantine(
        done.rows, F.col("row_bytes"), max_row_bytes, stream, F.lit(None), id_col=ids[0], key_col=None,
        payloads=[f for f in SPILLABLE_FIELDS if f in columns], columns=columns,
    )
    # A batch without oversize rows writes an empty partition, so a replay leaves no record of an earlier attempt.
    isolated = Observation()
    _write_partition(oversize.observe(isolated, F.count(F.lit(1)).alias("n")).withColumn(name, F.lit(number)), f"{sink.rstrip('/')}_quarantine", name)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    copied = F.col("attachments_copied") if ref_map is not None and payload is not None else F.lit(0)
    written = Observation()
    observed = fitting.observe(
        written,
        F.count(F.lit(1)).alias("inserted"),
        total(F.col("row_bytes") if size is None else size).alias("inserted_bytes"),
        total(copied).alias("attachments_copied"),
        total(F.col("spilled_fields")).alias("spilled_fields"),
    )
    _write_partition(observed.select(*columns).withColumn(name, F.lit(number)), sink, name)
    found = {**written.get, "quarantined": isolated.get["n"]}
    return {c: found[c] for c in WRITTEN}
