"""Source-to-destination identity: which destination object stands for a source object.

A mapping is a DataFrame ``(source_id, dest_id)`` holding each source id once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanferry.functions.scalars import norm_email
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, lookup


def has_value(col: Column, kind: T.DataType) -> Column:
    """Present and, for text, not blank; never null, and plain enough to be pushed into a scan."""
    return col.isNotNull() & (col != "") if isinstance(kind, T.StringType) else col.isNotNull()


def is_set(df: DataFrame, name: str) -> Column:
    """:func:`has_value` of a top-level column."""
    return has_value(F.col(name), df.schema[name].dataType)


def _one_per_name(dst: DataFrame, name: str, dest_id: str, position: Sequence[str], keep: str) -> DataFrame:
    """One destination id per name. The row limit is applied before the shuffle as well as after it."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last'; got {keep!r}")
    order = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in position]
    candidates = dst.where(is_set(dst, name) & is_set(dst, dest_id))
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    return ranked.where("_rank = 1").select(F.col(name).alias("_name"), F.col(dest_id).alias("dest_id"))


def match_by_name(
    src: DataFrame,
    dst: DataFrame,
    *,
    source_id: str,
    source_name: str,
    dest_id: str,
    dest_name: str,
    position: Sequence[str],
    keep: str = "last",
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Map source ids to destination ids of the same name.

    Missing and blank names never match. Among destination rows of one name, ``keep`` picks the last
    (bulk matching) or the first (on-demand and project matching) in listing order ``position``.
    """
    wanted = src.where(is_set(src, source_name)).select(
        F.col(source_id).alias("source_id"), F.col(source_name).alias("_name")
    )
    found = _one_per_name(dst, dest_name, dest_id, position, keep)
    # The listing bounds its own reduction to one row a name, and is cheaper to measure.
    small = fits_broadcast(dst.select(dest_name, dest_id), limits)
    return lookup(wanted, found, ["_name"], "inner", limits, small).select("source_id", "dest_id")


def match_by_email(
    src: DataFrame,
    dst: DataFrame,
    *,
    source_id: str,
    source_email: str,
    dest_id: str,
    dest_email: str,
    position: Sequence[str],
    explicit: DataFrame | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Map users by normalised e-mail; the first destination user wins, an explicit mapping comes first.

    Users without a match are not in the result.
    """
    normalised = dst.withColumn("_email", norm_email(F.col(dest_email)))
    found = _one_per_name(normalised, "_email", dest_id, position, "first").withColumnRenamed("_name", "_email")
    wanted = src.select(F.col(source_id).alias("source_id"), norm_email(F.col(source_email)).alias("_email"))
    small = fits_broadcast(dst.select(dest_email, dest_id), limits)
    matched = lookup(wanted, found, ["_email"], "left", limits, small)
    if explicit is not None:
        given = explicit.select("source_id", F.col("dest_id").alias("_given"))
        matched = lookup(matched, given, ["source_id"], "left", limits).withColumn(
            "dest_id", F.coalesce("_given", "dest_id")
        )
    return matched.where(F.col("dest_id").isNotNull()).select("source_id", "dest_id")


def missing_in_dest(
    src: DataFrame, dst: DataFrame, *, source_name: str, dest_name: str, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Source rows whose name does not exist in the destination: the objects to create."""
    existing = dst.select(F.col(dest_name).alias(source_name)).where(F.col(source_name).isNotNull()).distinct()
    small = fits_broadcast(dst.select(dest_name), limits)
    return lookup(src, existing, [source_name], "left_anti", limits, small).select(*src.columns)


def pair_read_only(
    src: DataFrame,
    dst: DataFrame,
    *,
    source_id: str,
    source_name: str,
    dest_id: str,
    dest_name: str,
    position: Sequence[str],
    names: DataFrame | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Dry-run pairing: every named source row with its destination id, or an empty string."""
    listed = src.where(is_set(src, source_id) & is_set(src, source_name))
    wanted = listed.select(F.col(source_id).alias("source_id"), F.col(source_name).alias("name"))
    if names is not None:
        wanted = lookup(wanted, names.select("name").distinct(), ["name"], "left_semi", limits)
    found = _one_per_name(dst, dest_name, dest_id, position, "last").withColumnRenamed("_name", "name")
    small = fits_broadcast(dst.select(dest_name, dest_id), limits)
    paired = lookup(wanted, found, ["name"], "left", limits, small)
    return paired.select("source_id", F.coalesce(F.col("dest_id").cast("string"), F.lit("")).alias("dest_id"), "name")


def merge_mappings(*maps: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Union of mappings in which a later one overrides an earlier one per key.

    Each input may carry duplicates of its own; those must agree or be ordered by a ``prio`` column.
    The union is collapsed before it is shuffled, so a key repeated in many rows costs one row a task.
    """
    if not maps:
        raise ValueError("at least one mapping is needed")
    ranked = None
    for rank, one in enumerate(maps):
        inner = F.col("prio").cast("int") if "prio" in one.columns else F.lit(0)
        tagged = one.select(*keys, "dest_id", F.struct(F.lit(rank).alias("map"), inner.alias("prio")).alias("_order"))
        ranked = tagged if ranked is None else ranked.unionByName(tagged)
    # The id is part of the ordering so that equal priorities resolve the same way on every run.
    best = F.max(F.struct("_order", F.col("dest_id"))).alias("_best")
    return ranked.groupBy(*keys).agg(best).select(*keys, F.col("_best.dest_id").alias("dest_id"))
