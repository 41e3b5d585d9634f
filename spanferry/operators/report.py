"""Counts, breakdowns and differences of migration results.

A result row is ``(scope, project, resource_type, source_id, dest_id, name, success, skipped,
skip_reason, error)``; every function uses only the columns it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.functions.scalars import reason_words, truncate_value

# How many items a report lists per reason, and a difference per class.
ITEMS_PER_REASON = 10
SAMPLE_NAMES = 3
BYTES_PER_GB = 1e9


def _status_aggregates() -> list[Column]:
    success, skipped = F.col("success"), F.coalesce("skipped", F.lit(False))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(success & ~skipped).alias("migrated"),
        F.count_if(success & skipped).alias("skipped"),
        F.count_if(~success).alias("failed"),
    ]


def status_counts(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, migrated, skipped and failed rows per key."""
    return results.groupBy(*keys).agg(*_status_aggregates())


def status_rollup(results: DataFrame, outer: str = "project", inner: str = "resource_type") -> DataFrame:
    """The same counts per project and type, per project, and overall.

    ``level`` is 0 for a type, 1 for a project and 3 for the whole run. Organisation-wide results carry
    a null project and appear beside the projects.
    """
    return results.rollup(outer, inner).agg(F.grouping_id().cast("int").alias("level"), *_status_aggregates())


def skip_breakdown(results: DataFrame, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """Skipped rows per reason, with the position at which a reason was first seen."""
    return (
        results.where(F.col("success") & F.col("skipped"))
        .groupBy(*keys, F.coalesce("skip_reason", F.lit("unknown")).alias("skip_reason"))
        .agg(F.count(F.lit(1)).alias("items"), F.min(position).alias("first_seen"))
    )


def skip_summary(breakdown: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``"3 already migrated, 1 code bundle"``: the reasons of each key in first-seen order.

    Runs on the output of :func:`skip_breakdown`, which has one row per key and reason.
    """
    part = F.struct(
        "first_seen", "skip_reason", F.concat_ws(" ", F.col("items").cast("string"), reason_words(F.col("skip_reason"))).alias("text")
    )
    ordered = F.array_sort(F.collect_list(part))
    return breakdown.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ", ").alias("summary"))


def max_xact(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest transaction id: as a number when every id is one, else as text; null without ids."""
    text = F.nullif(F.col(col).cast("string"), F.lit(""))
    number = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("decimal(38,0)"))
    all_numbers = F.bool_and(F.when(text.isNotNull(), number.isNotNull()))
    return df.groupBy(*keys).agg(
        F.when(all_numbers, F.max(number).cast("string")).otherwise(F.max(text)).alias("max_xact")
    )


def stream_counters(tagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counters of a stream from rows tagged with ``outcome`` and sizes.

    ``outcome`` is ``inserted``, ``deleted`` or ``seen``; ``row_bytes``, ``attachments_copied`` and
    ``spilled_fields`` count for inserted rows only.
    """
    def outcome(name: str) -> Column:
        return F.coalesce(F.col("outcome") == name, F.lit(False))

    def total(col: str) -> Column:
        value = F.coalesce(F.sum(F.when(outcome("inserted"), F.col(col).cast("long"))), F.lit(0))
        return value.cast("long").alias("inserted_bytes" if col == "row_bytes" else col)

    return tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(outcome("inserted")).alias("inserted"),
        total("row_bytes"),
        F.count_if(outcome("deleted")).alias("skipped_deleted"),
        F.count_if(outcome("seen")).alias("skipped_seen"),
        total("attachments_copied"),
        total("spilled_fields"),
    )


def throughput(counters: DataFrame, seconds: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, GB and both per second; the rates are null when no time passed.

    ``counters`` has ``inserted`` and ``inserted_bytes``; ``seconds`` is an aggregate or a literal.
    """
    rows = F.coalesce(F.sum("inserted"), F.lit(0)).cast("long")
    gigabytes = F.coalesce(F.sum("inserted_bytes"), F.lit(0)) / F.lit(BYTES_PER_GB)
    duration = F.when(seconds > 0, seconds.cast("double"))
    return counters.groupBy(*keys).agg(
        rows.alias("rows_total"),
        gigabytes.alias("gb_total"),
        (rows / duration).alias("rows_per_sec"),
        (gigabytes / duration).alias("gb_per_sec"),
    )


def report_success(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """True when nothing failed and nothing reported an error; an empty run succeeds."""
    bad = ~F.col("success") | F.col("error").isNotNull()
    return results.groupBy(*keys).agg((F.count_if(bad) == 0).alias("success"))


def discovery_summary(
    df: DataFrame, kind: str, name: str, position: Sequence[str], samples: int = SAMPLE_NAMES
) -> DataFrame:
    """Objects per type and the first few names; a missing name is shown as ``unnamed``."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("discovered"))
    # Only the first few names of a type leave a task, however many objects it has.
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*position))
    top = df.select(kind, name, *[c for c in position if c not in (kind, name)]).withColumn("_rank", rank)
    names = (
        top.where(F.col("_rank") <= samples)
        .groupBy(kind)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.coalesce(name, F.lit("unnamed")).alias("name")))).alias("_top"))
        .select(kind, F.transform("_top", lambda x: x["name"]).alias("sample_names"))
    )
    same = F.col(f"c.{kind}").eqNullSafe(F.col(f"n.{kind}"))
    return counts.alias("c").join(names.alias("n"), same, "left").select("c.*", "n.sample_names")


def top_n_per_reason(
    results: DataFrame, position: Sequence[str], reason: str = "skip_reason", n: int = ITEMS_PER_REASON
) -> DataFrame:
    """The first ``n`` items of each reason, the size of the reason and how many items are not listed.

    Items without a reason are listed as ``unknown``.
    """
    results = results.withColumn(reason, F.coalesce(F.col(reason), F.lit("unknown")))
    rank = F.row_number().over(Window.partitionBy(reason).orderBy(*position))
    listed = results.withColumn("item_no", rank).where(F.col("item_no") <= n)
    sizes = results.groupBy(reason).agg(F.count(F.lit(1)).alias("items"))
    # Both sides are reduced: n rows and one row per reason.
    return listed.join(sizes, [reason]).withColumn("more", F.greatest(F.col("items") - n, F.lit(0)))


BREAKDOWN_COLUMNS = (
    "outcome", "scope", "project", "resource_type", "source_id", "dest_id", "name", "skip_reason", "error",
)


def breakdown(*results: DataFrame) -> DataFrame:
    """One long table of migrated, skipped and failed items; absent columns are null."""
    merged = results[0]
    for one in results[1:]:
        merged = merged.unionByName(one, allowMissingColumns=True)
    for name in BREAKDOWN_COLUMNS[1:]:
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast("string"))
    skipped = F.coalesce("skipped", F.lit(False))
    outcome = F.when(~F.col("success"), "failed").when(skipped, "skipped").otherwise("migrated")
    return (
        merged.withColumn("outcome", outcome)
        .withColumn("dest_id", F.when(F.col("success"), F.col("dest_id")))
        .withColumn("skip_reason", F.when(F.col("outcome") == "skipped", F.coalesce("skip_reason", F.lit("unknown"))))
        .withColumn("error", F.when(F.col("outcome") == "failed", F.col("error")))
        .select(*BREAKDOWN_COLUMNS)
    )


def missing_names(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested names that were not found, each once."""
    return requested.select(F.col(requested.columns[0]).alias("name")).subtract(
        found.select(F.col(found.columns[0]).alias("name"))
    )


def schema_diff(
    old: DataFrame, new: DataFrame, max_items: int | None = None
) -> DataFrame:
    """Differences of two ``(path, type, value)`` tables by class, in path order.

    Classes are ``added``, ``removed``, ``type_changes`` and ``values_changed`` (same type); paths that
    end in a list position, such as ``tags[2]``, are ``iterable_added`` and ``iterable_removed``. Values are
    rendered text and are shortened. Every path is listed, or the first ``max_items`` of each class; ``more`` tells how many are not.
    """
    left = old.select("path", F.col("type").alias("old_type"), F.col("value").alias("old_value"), F.lit(True).alias("_o"))
    right = new.select("path", F.col("type").alias("new_type"), F.col("value").alias("new_value"), F.lit(True).alias("_n"))
    in_list = F.col("path").rlike(r"\[\d+\]$")
    change = (
        F.when(F.col("_o").isNull(), F.when(in_list, "iterable_added").otherwise("added"))
        .when(F.col("_n").isNull(), F.when(in_list, "iterable_removed").otherwise("removed"))
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changes")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "values_changed")
    )
    # Paths are unique on both sides, so no key of this join is hot.
    differing = (
        left.join(right, ["path"], "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(
            "change",
            "path",
            F.when(F.col("change") == "type_changes", F.col("old_type")).alias("old_type"),
            F.when(F.col("change") == "type_changes", F.col("new_type")).alias("new_type"),
            F.when(F.col("change") == "values_changed", truncate_value(F.col("old_value"))).alias("old_value"),
            F.when(F.col("change") == "values_changed", truncate_value(F.col("new_value"))).alias("new_value"),
        )
    )
    if max_items is None:
        return differing.withColumn("more", F.lit(0).cast("long"))
    return top_n_per_reason(differing, ["path"], "change", max_items).drop("item_no", "items")
