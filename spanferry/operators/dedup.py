"""Duplicates within a table, rows already in the target, and references that cannot be resolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, lookup
from spanferry.operators.resolve import is_set
from spanferry.shared import settle


def _has_id(df: DataFrame, ids: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in ids:
        present = present & is_set(df, name)
    return present


def _tie(df: DataFrame) -> Column:
    """A digest of the row, so that a tie has the same outcome in every evaluation."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def dedup_first(df: DataFrame, ids: Sequence[str], order_by: Sequence[str], ids_present: bool = False) -> DataFrame:
    """The first row of each id in ``order_by`` order; rows without an id are all kept.

    Of rows that tie in ``order_by`` one is chosen by its content, the same whenever the plan is run. The one-row limit also runs before the shuffle,
    so an id repeated in a third of all rows sends one row per task. ``ids_present`` says that no id
    is null or blank and saves the pass for rows without one.
    """
    first = F.row_number().over(Window.partitionBy(*ids).orderBy(*order_by, _tie(df)))
    named = df if ids_present else df.where(_has_id(df, ids))
    winners = named.withColumn("_rank", first).where("_rank = 1").drop("_rank")
    return winners if ids_present else winners.unionByName(df.where(~_has_id(df, ids)))


def dedup_first_wide(
    df: DataFrame, ids: Sequence[str], order_by: Sequence[str], limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """The rows of :func:`dedup_first`, without sorting or shuffling the payload of rows that stay.

    For wide rows whose ids mostly occur once. A count over the id columns finds the ids that occur more
    often, and the order columns of their rows tell which one is first; broadcast, that is enough to
    keep or drop every row where it was read. Only ids whose first place is tied need their tied rows
    compared. When too many ids repeat to be broadcast, or most rows are copies that are best dropped by
    the row limit before the shuffle, this is :func:`dedup_first`.
    """
    keys = list(ids)
    repeated = settle(
        df.where(_has_id(df, ids)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    copies = repeated.agg(F.sum("_n").alias("n")).first()["n"]
    if copies is None:
        return df
    if copies * 2 > df.count() or not fits_broadcast(repeated, limits):
        return dedup_first(df, ids, order_by)
    order, narrow = F.struct(*order_by), list(dict.fromkeys([*keys, *order_by]))
    contested = df.select(*narrow).join(F.broadcast(repeated.select(*keys)), keys)
    firsts = settle(contested.groupBy(*keys).agg(F.min(order).alias("_first")))
    if not fits_broadcast(firsts, limits):
        return dedup_first(df, ids, order_by)
    is_first = order == F.col("_first")
    places = df.select(*narrow).join(F.broadcast(firsts), keys).where(is_first)
    tied = settle(
        places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_tied"))
    )
    marked = df.join(F.broadcast(firsts.join(F.broadcast(tied), keys, "left")), keys, "left")
    leading = marked.where(F.col("_first").isNull() | is_first)
    if tied.isEmpty():
        return leading.select(*df.columns)
    alone = leading.where(F.col("_tied").isNull()).select(*df.columns)
    return alone.unionByName(dedup_first(leading.where("_tied").select(*df.columns), ids, order_by, ids_present=True))


def dedup_counts(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row: fetched, kept, skipped_seen and no_id rows; ``fetched = kept + skipped_seen``."""
    per_id = (
        df.groupBy(_has_id(df, ids).alias("_named"), *[F.when(_has_id(df, ids), F.col(c)).alias(c) for c in ids])
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    named = F.sum(F.when(F.col("_named"), F.lit(1)).otherwise(F.lit(0)))
    no_id = F.coalesce(F.sum(F.when(~F.col("_named"), F.col("_n"))), F.lit(0))
    fetched = F.coalesce(F.sum("_n"), F.lit(0))
    kept = F.coalesce(named, F.lit(0)) + no_id
    return per_id.agg(
        fetched.alias("fetched"), kept.alias("kept"), (fetched - kept).alias("skipped_seen"), no_id.alias("no_id")
    )


def anti_seen(
    df: DataFrame, target: DataFrame, ids: Sequence[str], limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Rows whose id is not in the target; rows without an id are kept.

    When the ids of ``df`` are small enough to broadcast (a micro-batch, an increment), they
    reduce the target's key column in place and the target is never shuffled. A larger ``df`` meets the
    target's keys in an ordinary shuffled anti-join.
    """
    keys = list(ids)
    incoming = df.select(*keys)
    # Rows stored without an id say nothing about rows that arrive without one.
    stored = target.where(_has_id(target, ids)).select(*keys)
    few = fits_broadcast(incoming, limits)
    if few:
        stored = stored.join(F.broadcast(incoming.distinct()), keys, "left_semi")
    # What is left of the target after that is a subset of the incoming ids, so it is as small.
    small = few or fits_broadcast(stored, limits)
    return lookup(df, stored.distinct(), keys, "left_anti", limits, small).select(*df.columns)


def skip_migrated(
    df: DataFrame, mapping: DataFrame, id_col: str, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``dest_id, skipped, skip_reason``: an object with a mapping is skipped as already migrated."""
    pairs = mapping.select(F.col("source_id").alias(id_col), "dest_id", F.lit(True).alias("skipped"))
    out = lookup(df, pairs, [id_col], "left", limits)
    skipped = F.coalesce("skipped", F.lit(False))
    return out.select(
        *df.columns,
        "dest_id",
        skipped.alias("skipped"),
        F.when(skipped, F.lit("already_migrated")).alias("skip_reason"),
    )


def unresolved_refs(
    edges: DataFrame, mapping: DataFrame, strict: bool = False, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Edges ``(src_type, src_id, dep_type, dep_id)`` whose target has no mapping.

    ``mapping`` is ``(source_id, dest_id)`` or carries ``resource_type`` as well. In ``strict`` mode an
    unresolved reference fails the job, naming the first few.
    """
    typed = "resource_type" in mapping.columns
    names = {"source_id": "dep_id", **({"resource_type": "dep_type"} if typed else {})}
    on = ["dep_type", "dep_id"] if typed else ["dep_id"]
    known = mapping.where(is_set(mapping, "dest_id")).select(*[F.col(s).alias(t) for s, t in names.items()])
    open_edges = lookup(edges, known, on, "left_anti", limits).select(*edges.columns)
    if strict:
        first = [row["dep_id"] for row in open_edges.select("dep_id").limit(5).collect()]
        if first:
            raise ValueError(f"unresolved dependencies: {first}")
    return open_edges
