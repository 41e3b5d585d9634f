"""Column allow-lists, stamps and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.functions.predicates import is_tombstone
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, lookup, nullable
from spanferry.operators.resolve import is_set

# Columns of an event row that the destination accepts on insert, by kind of event.
EVENT_COLUMNS: dict[str, tuple[str, ...]] = {
    "logs": (
        "input", "output", "expected", "error", "scores", "metadata", "tags", "metrics", "context",
        "span_attributes", "id", "created", "origin", "_object_delete", "_is_merge", "_merge_paths",
        "_array_delete", "_parent_id", "span_id", "root_span_id", "span_parents",
    ),
    "experiments": (
        "input", "output", "expected", "error", "scores", "metadata", "tags", "metrics", "context",
        "span_attributes", "id", "created", "origin", "_object_delete", "_is_merge", "_merge_paths",
        "_array_delete", "_parent_id", "span_id", "root_span_id", "span_parents",
    ),
    "datasets": (
        "input", "expected", "metadata", "tags", "id", "created", "origin", "_object_delete", "_is_merge",
        "_merge_paths", "_array_delete", "_parent_id", "span_id", "root_span_id", "span_parents",
    ),
}

# Columns an object carries that a create call must not send.
READ_ONLY_COLUMNS = ("id", "_xact_id", "_pagination_key", "org_id", "created", "deleted_at")

# Object types of provenance stamps, and of the types that can be requested per scope.
ORIGIN_TYPES = {"logs": "project_logs", "experiments": "experiment", "datasets": "dataset"}
PROJECT_LOGS_LOG_ID = "g"


def project_allowed(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Only the allowed columns that exist, in the input's order."""
    wanted = set(allowed)
    return df.select(*[c for c in df.columns if c in wanted])


def event_insert_projection(
    df: DataFrame, kind: str, schema_columns: Iterable[str] | None = None, id_col: str = "id"
) -> DataFrame:
    """Columns an event of ``kind`` is inserted with; the id is always kept.

    Experiments and datasets prefer a supplied schema's columns over the fixed list; logs never do.
    """
    allowed = set(EVENT_COLUMNS[kind])
    if schema_columns is not None and kind != "logs":
        allowed = set(schema_columns) or allowed
    return project_allowed(df, allowed | {id_col})


def strip_readonly(df: DataFrame, columns: Sequence[str] = READ_ONLY_COLUMNS) -> DataFrame:
    """Without a known schema: everything but the read-only columns."""
    return df.drop(*columns)


def created_between(
    df: DataFrame, col: str, after: object | None = None, before: object | None = None
) -> DataFrame:
    """Rows in the half-open range ``[after, before)``; an empty bound is no bound."""
    kind = df.schema[col].dataType
    if after not in (None, ""):
        df = df.where(F.col(col) >= F.lit(after).cast(kind))
    if before not in (None, ""):
        df = df.where(F.col(col) < F.lit(before).cast(kind))
    return df


def drop_tombstones(df: DataFrame, flag: Column | str) -> DataFrame:
    """Rows whose delete flag is not strictly true."""
    return df.where(~is_tombstone(F.col(flag) if isinstance(flag, str) else flag))


def valid_records(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required columns are all non-blank."""
    for name in required:
        df = df.where(is_set(df, name))
    return df


def malformed_count(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: well-formed and malformed rows."""
    good = F.lit(True)
    for name in required:
        good = good & is_set(df, name)
    return df.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("malformed"))


def select_by_name(
    df: DataFrame, name: str, names: DataFrame | None = None, limits: JoinLimits = DEFAULT_LIMITS
) -> tuple[DataFrame, DataFrame | None]:
    """The named rows (all without ``names``) and the requested names that do not exist."""
    if names is None:
        return df, None
    wanted = names.select(F.col(names.columns[0]).alias(name)).distinct()
    found = lookup(df, wanted, [name], "left_semi", limits, fits_broadcast(names, limits)).select(*df.columns)
    small = fits_broadcast(df.select(name), limits)
    missing = lookup(wanted, df.select(name).distinct(), [name], "left_anti", limits, small)
    return found, missing


def stamp_origin(
    df: DataFrame,
    object_type: str,
    object_id: Column,
    id_col: str = "id",
    xact_col: str | None = "_xact_id",
    created_col: str | None = "created",
    origin: str = "origin",
) -> DataFrame:
    """Where a row came from, unless it already says so.

    The stamp is ``{object_type, object_id, id, _xact_id, created}``; absent parts are null.
    """
    columns = set(df.columns)

    def part(name: str | None, kind: str) -> Column:
        return F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)

    created_kind = df.schema[created_col].dataType.simpleString() if created_col in columns else "timestamp"
    stamp = F.struct(
        F.lit(object_type).alias("object_type"),
        object_id.cast("string").alias("object_id"),
        part(id_col, "string").alias("id"),
        part(xact_col, "string").alias("_xact_id"),
        part(created_col, created_kind).alias("created"),
    )
    if origin in columns:
        stamp = F.coalesce(F.col(origin), stamp.cast(nullable(df.schema[origin].dataType)))
    return df.withColumn(origin, stamp)


def stamp_destination(df: DataFrame, **ids: object) -> DataFrame:
    """Overwrite the owning-object columns of every row."""
    return df.withColumns({name: F.lit(value) for name, value in ids.items()})


def stamp_project_logs(df: DataFrame, project_id: str) -> DataFrame:
    """Destination columns of a project-log row."""
    return stamp_destination(df, project_id=project_id, log_id=PROJECT_LOGS_LOG_ID)


def select_resource_types(
    df: DataFrame, type_col: str, requested: Sequence[str], scope: Sequence[str]
) -> DataFrame:
    """Rows of the requested types that belong to the scope; ``all`` requests the whole scope."""
    chosen = list(scope) if "all" in requested else [t for t in scope if t in set(requested)]
    return df.where(F.col(type_col).isin(*chosen)) if chosen else df.where(F.lit(False))


def require_object_id(df: DataFrame, col: str, what: str = "event") -> DataFrame:
    """Pass rows through, failing the job on the first row without its owning object id.

    The check sits in the column itself, so it cannot be pruned while the column is used.
    """
    kind = df.schema[col].dataType
    checked = F.when(is_set(df, col), F.col(col)).otherwise(F.raise_error(F.lit(f"{what} row without {col}")).cast(kind))
    return df.withColumn(col, checked)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Give source columns the names an operator expects."""
    return df.withColumnsRenamed(dict(names))
