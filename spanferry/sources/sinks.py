"""Routed writes, quarantine and reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from spanferry.functions.payload import REFERENCE_TAG, count_attachment_refs
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits
from spanferry.operators.remap import remap_fk
from spanferry.operators.report import breakdown, status_counts, status_rollup
from spanferry.shared import read_stored

MAX_ROWS_PER_FILE = 5_000_000

# Up to this many destinations have a folder each; files, renames and listings grow with the folders, not with the rows.
MAX_FOLDERS = 1_000

# The folder level that keeps the rows of one run apart from those of others.
RUN_COLUMN = "copy_run"


def new_run() -> str:
    """A name no other run has. Pass it to every attempt of a run, so that a repeated attempt replaces its own rows."""
    return f"run-{uuid.uuid4().hex}"


def write_run(writer: DataFrameWriter, path: str, *folders: str) -> None:
    """Add a run's rows, which carry ``RUN_COLUMN``, to ``path``; rows of other runs stay."""
    dynamic = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy(RUN_COLUMN, *folders).parquet(path)


def read_run(spark: SparkSession, path: str, schema: T.StructType, run: str) -> DataFrame:
    """The rows that one run has written to ``path``."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN_COLUMN, T.StringType())])).parquet(path)
    return stored.where(F.col(RUN_COLUMN) == run).drop(RUN_COLUMN)


def route(
    df: DataFrame, route_map: DataFrame, src_col: str, dest_col: str, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Add the destination of each row's source object; a row without one fails the job."""
    missing = F.raise_error(F.lit(f"row without {src_col}")).cast(df.schema[src_col].dataType)
    routed = df.withColumn(dest_col, F.coalesce(F.col(src_col), missing))
    return remap_fk(routed, route_map, dest_col, on_miss="fail", limits=limits)


def _has_folders(spark: SparkSession, path: str) -> bool | None:
    """Whether the rows stored at ``path`` lie in folders by destination; None when there are none."""
    stored = read_stored(spark, path, T.StructType([T.StructField(RUN_COLUMN, T.StringType())]))
    first = None if stored is None else stored.select("_metadata.file_path").first()
    return None if first is None else "/" in first["file_path"].rsplit(f"/{RUN_COLUMN}=", 1)[-1].split("/", 1)[-1]


def write_routed(
    df: DataFrame,
    route_map: DataFrame,
    src_col: str,
    dest_col: str,
    path: str,
    order_by: Sequence[str] = (),
    limits: JoinLimits = DEFAULT_LIMITS,
    run: str | None = None,
    max_folders: int = MAX_FOLDERS,
) -> None:
    """Add each source object's rows under its destination, in folders ``copy_run=<run>/<dest_col>=<id>``.

    Rows of earlier runs stay; writing the same ``run`` again replaces its rows. Without a name every call is a run.

    Rows are range-partitioned on (destination, order), which packs small destinations together and
    splits a large one over many tasks, so neither tiny files nor one huge task arise.

    When ``route_map`` names more than ``max_folders`` destinations, ``dest_col`` is a column of the files in ``copy_run=<run>``
    instead. They are sorted by it, so the range of each file tells a reader of one destination which to skip. A folder cannot
    hold both layouts: later runs follow the one that is there.
    """
    routed = route(df, route_map, src_col, dest_col, limits)
    keys = [dest_col, *order_by] if order_by else [dest_col, *[c for c in df.columns if c != dest_col][:1]]
    laid_out = routed.withColumn(RUN_COLUMN, F.lit(run or new_run())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    folders = _has_folders(df.sparkSession, path)
    if folders is None:
        folders = route_map.select("dest_id").distinct().limit(max_folders + 1).count() <= max_folders
    write_run(laid_out.write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE), path, *([dest_col] if folders else []))


def _present_keys(columns: Sequence[str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in columns])))


def quarantine(
    df: DataFrame,
    size: Column,
    max_bytes: int,
    stream: str,
    dest_id: Column,
    *,
    id_col: str = "id",
    key_col: str | None = "_pagination_key",
    payloads: Sequence[str] = (),
    approx_size: Column | None = None,
    tag: str = REFERENCE_TAG,
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows within the size limit, and one summary record for each row above it.

    The record names the row, its size, the references in its ``payloads`` and its columns (or those of ``columns``) in order.
    """
    over = F.coalesce(size > max_bytes, F.lit(False))

    def column(name: str | None, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    refs = F.lit(0)
    for payload in payloads:
        refs = refs + F.coalesce(count_attachment_refs(F.col(payload), tag), F.lit(0))
    oversize = df.where(over)
    summary = oversize.select(
        F.lit(stream).alias("stream"),
        F.concat(F.lit("row of "), size.cast("string"), F.lit(f" bytes exceeds {max_bytes}")).alias("error"),
        column(key_col).alias("cursor"),
        dest_id.cast("string").alias("dest_id"),
        column(id_col).alias("event_id"),
        column("root_span_id").alias("root_span_id"),
        column("span_id").alias("span_id"),
        column("created", "timestamp").alias("created"),
        (approx_size if approx_size is not None else size).cast("long").alias("approx_size"),
        refs.cast("int").alias("attachment_refs"),
        _present_keys(df.columns if columns is None else columns).alias("top_level_keys"),
    )
    return df.where(~over), summary


def nested_report(results: DataFrame) -> DataFrame:
    """One row per project with its totals and an array of per-type counts, by type.

    ``results`` are counted per (project, type) first, so the arrays hold one entry per resource type.
    """
    per_type = status_counts(results, ["project", "resource_type"])
    entry = F.struct("resource_type", "total", "migrated", "skipped", "failed")
    return per_type.groupBy("project").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("total", "migrated", "skipped", "failed")],
        F.array_sort(F.collect_list(entry)).alias("resources"),
    )


def write_report(results: DataFrame, path: str) -> None:
    """Write ``breakdown`` (per item, by outcome), ``summary`` (rollup) and ``projects`` (nested).

    The counts are taken from the items as written, so the copy behind ``results`` runs once.
    """
    items = breakdown(results)
    # Static: a report replaces the one before, outcomes that no longer occur included.
    items.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("outcome").parquet(f"{path}/breakdown")
    written = items.sparkSession.read.schema(items.schema).parquet(f"{path}/breakdown")
    counted = written.select(
        "project",
        "resource_type",
        (F.col("outcome") != "failed").alias("success"),
        (F.col("outcome") == "skipped").alias("skipped"),
    )
    status_rollup(counted).write.mode("overwrite").json(f"{path}/summary")
    nested_report(counted).write.mode("overwrite").json(f"{path}/projects")
