"""Payload rewrites that move or re-point large values: oversize spill and attachment copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanferry.functions.payload import (
    REFERENCE_TAG,
    attachment_refs,
    json_value_bytes,
    may_hold_reference,
    replace_attachment_refs,
)
from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, lookup
from spanferry.shared import settle

# The row cap, the smallest field worth moving, and the fields that may be moved.
MAX_ROW_BYTES = 18 * 1024 * 1024
MIN_SPILL_BYTES = 64 * 1024
SPILLABLE_FIELDS = ("input", "output", "metadata", "expected", "error", "span_attributes")


def side_key(stream: Column, row_id: Column, field: Column, value: Column) -> Column:
    """Key of a side-table value: the same on every attempt, so a re-run task writes the same key.

    The value's digest is part of it: rows without an id, or with one id, only share a key when they share the value.
    """
    return F.sha2(F.concat_ws("|", stream, F.coalesce(row_id.cast("string"), F.lit("")), field, F.sha2(value, 256)), 256)


def reference_json(key: Column, filename: Column, content_type: Column, tag: str = REFERENCE_TAG) -> Column:
    """The reference object left in place of a value."""
    parts = [
        F.lit(tag).alias("type"),
        key.alias("key"),
        filename.alias("filename"),
        content_type.alias("content_type"),
    ]
    return F.to_json(F.struct(*parts))


@dataclass(frozen=True)
class Spilled:
    """Rows with small fields only, and the side table ``(stream, event_id, field, key, payload)``."""

    rows: DataFrame
    side: DataFrame


def spill_oversize(
    df: DataFrame,
    id_col: str,
    stream: str,
    fields: Sequence[str] = SPILLABLE_FIELDS,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
    row_bytes: Column | None = None,
    tag: str = REFERENCE_TAG,
    as_json: bool = False,
    isolate_over: int | None = None,
) -> Spilled:
    """Move the largest fields of oversize rows to a side table until the row fits.

    Fields hold JSON (or plain) text. Only fields of at least ``min_field_bytes`` that are not already
    a reference are moved, largest first and in ``fields`` order when equal, and only while the row is
    over the cap. ``row_bytes`` is the size of the whole row, by default the sum over ``fields``; with ``as_json`` it
    counts the row as JSON, and so does what a move saves. The rows gain ``spilled_fields`` and ``row_bytes`` (the new size).
    With ``isolate_over`` the side table leaves out values of rows that stay larger than that.
    """
    present = [f for f in fields if f in df.columns]
    if not present:
        rows = df.withColumns({"spilled_fields": F.lit(0), "row_bytes": F.lit(0).cast("long") if row_bytes is None else row_bytes.cast("long")})
        columns = {"stream": "string", "event_id": df.schema[id_col].dataType, "field": "string", "key": "string", "payload": "string"}
        return Spilled(rows, df.where(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()]))
    size = {f: F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in present}
    total = row_bytes.cast("long") if row_bytes is not None else sum(size.values(), F.lit(0).cast("long"))
    id_text = F.col(id_col)

    def moved(field: str, key: Column | None = None) -> Column:
        key = side_key(F.lit(stream), id_text, F.lit(field), F.col(field)) if key is None else key
        return reference_json(key, F.lit(f"{field}.json"), F.lit("application/json"), tag)

    def saved(field: str) -> Column:
        # Every key is as long as this one.
        reference = F.octet_length(moved(field, F.lit("0" * 64)))
        held = json_value_bytes(F.col(field)) if as_json else F.octet_length(field)
        return (F.coalesce(held, F.lit(0)) - reference).cast("long")

    def eligible(field: str) -> Column:
        is_reference = F.coalesce(F.get_json_object(F.when(F.col(field).startswith("{") & F.col(field).contains(tag), F.col(field)), "$.type") == tag, F.lit(False))
        return F.coalesce(size[field] >= min_field_bytes, F.lit(False)) & F.col(field).isNotNull() & ~is_reference

    # At most len(fields) candidates a row. Sorting by (-size, place) is "largest first, then field order".
    candidates = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        eligible(f),
                        F.struct(
                            (-size[f]).alias("order"),
                            F.lit(i).alias("place"),
                            saved(f).alias("saved"),
                            F.lit(f).alias("field"),
                        ),
                    )
                    for i, f in enumerate(present)
                ]
            )
        )
    )
    start = F.struct(F.col("_total").alias("left"), F.array().cast("array<string>").alias("fields"))

    def move(state: Column, candidate: Column) -> Column:
        fits = state["left"] <= max_row_bytes
        return F.when(fits, state).otherwise(
            F.struct(
                (state["left"] - candidate["saved"]).alias("left"),
                F.array_append(state["fields"], candidate["field"]).alias("fields"),
            )
        )

    tagged = df.withColumn("_total", total).withColumn(
        "_plan", F.when(F.col("_total") > max_row_bytes, F.aggregate(candidates, start, move)).otherwise(start)
    )
    goes = {f: F.array_contains("_plan.fields", f) for f in present}
    rows = tagged.select(
        *[F.when(goes[c], moved(c)).otherwise(F.col(c)).alias(c) if c in goes else F.col(c) for c in df.columns],
        F.size("_plan.fields").alias("spilled_fields"),
        F.col("_plan.left").alias("row_bytes"),
    )
    side = (
        tagged.where((F.size("_plan.fields") > 0) & (F.lit(True) if isolate_over is None else F.col("_plan.left") <= isolate_over))
        .select(
            id_text.alias("event_id"),
            F.explode(
                F.array_compact(
                    F.array(
                        *[
                            F.when(goes[f], F.struct(F.lit(f).alias("field"), F.col(f).alias("payload")))
                            for f in present
                        ]
                    )
                )
            ).alias("_v"),
        )
        .select(
            F.lit(stream).alias("stream"),
            "event_id",
            "_v.field",
            side_key(F.lit(stream), F.col("event_id"), F.col("_v.field"), F.col("_v.payload")).alias("key"),
            "_v.payload",
        )
    )
    return Spilled(rows, side)


def row_json_bytes(df: DataFrame, json_fields: Sequence[str] = SPILLABLE_FIELDS) -> Column:
    """UTF-8 bytes of the whole row as one JSON object: names, punctuation, arrays, structs and numbers included, nulls left out.

    Text in ``json_fields`` counts as :func:`json_value_bytes` says, any other text as a string.
    """
    fields = [f for f in json_fields if f in df.columns and df.schema[f].dataType.simpleString() == "string"]
    others = [c for c in df.columns if c not in fields]
    rest = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))) if others else F.lit(2)
    total = rest
    for name in fields:
        # The name in quotes, a colon, and the comma before the next member.
        total = total + F.coalesce(json_value_bytes(F.col(name)) + len(name.encode()) + 4, F.lit(0))
    # Members are separated, not ended, by commas; those in ``rest`` already are.
    any_field = F.coalesce(*[F.col(f) for f in fields]).isNotNull() if fields else F.lit(False)
    return (total - F.when((rest == 2) & any_field, 1).otherwise(0)).cast("long")


def finish_rows(
    df: DataFrame,
    id_col: str,
    stream: str,
    ref_map: DataFrame | None = None,
    payload: str | None = None,
    fields: Sequence[str] = SPILLABLE_FIELDS,
    max_row_bytes: int = MAX_ROW_BYTES,
    min_field_bytes: int = MIN_SPILL_BYTES,
    limits: JoinLimits = DEFAULT_LIMITS,
    isolate_over: int | None = None,
) -> Spilled:
    """The last stages of every copy: attachment references in ``payload``, then oversize fields.

    The cap holds for the row as JSON. The rows gain ``spilled_fields``, ``row_bytes`` (as JSON) and, when a ``ref_map`` is
    given, the columns of :func:`rewrite_attachments`. Rows that no move brings under ``isolate_over`` (by default the cap)
    keep a larger ``row_bytes``, and the side table holds nothing of them.
    """
    row_bytes = row_json_bytes(df, fields)
    if ref_map is not None and payload is not None:
        df = rewrite_attachments(df, ref_map, payload, limits=limits)
    isolate_over = max_row_bytes if isolate_over is None else isolate_over
    return spill_oversize(df, id_col, stream, fields, max_row_bytes, min_field_bytes, row_bytes, as_json=True, isolate_over=isolate_over)


def distinct_attachments(df: DataFrame, payload: str, tag: str = REFERENCE_TAG) -> DataFrame:
    """Each distinct source key once, with the file name and type of one of its references."""
    refs = df.where(may_hold_reference(F.col(payload), tag)).select(
        F.explode(attachment_refs(F.col(payload), tag)).alias("ref")
    )
    # min() over the whole tuple combines before the shuffle and picks the same copy on every run.
    return (
        refs.groupBy(F.col("ref.key").alias("source_key"))
        .agg(F.min(F.struct("ref.filename", "ref.content_type")).alias("_f"))
        .select("source_key", "_f.filename", "_f.content_type")
    )


def planned_copies(attachments: DataFrame, stream: str) -> DataFrame:
    """The copy to make of each attachment: ``(source_key, dest_key, filename, content_type)``."""
    return attachments.select(
        "source_key",
        F.sha2(F.concat_ws("|", F.lit(stream), "source_key"), 256).alias("dest_key"),
        "filename",
        "content_type",
    )


def rewrite_attachments(
    df: DataFrame,
    ref_map: DataFrame,
    payload: str,
    tag: str = REFERENCE_TAG,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Point every nested reference at its copy; add ``attachments_copied`` and ``payload_unread``.

    ``ref_map`` is ``(source_key, dest_key, filename, content_type)``, each source key once; references
    that were not copied stay. What becomes of a payload depends on its text alone, so the copies it
    needs are gathered per digest of the text: row ids may be null or repeat, and equal payloads in a
    third of all rows are looked up once. Payloads without the tag are not shuffled. A payload that is
    not JSON stays as it is, with ``payload_unread`` 1.
    """
    holds = F.coalesce(may_hold_reference(F.col(payload), tag), F.lit(False))
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    keys = F.transform(attachment_refs(F.col(payload), tag), lambda ref: ref["key"])
    needed = df.where(holds).select(digest.alias("_digest"), F.explode(keys).alias("source_key")).distinct()
    copies = ref_map.select(
        "source_key", reference_json(F.col("dest_key"), F.col("filename"), F.col("content_type"), tag).alias("_new")
    )
    # A map holds one entry per reference of one payload.
    per_text = settle(
        lookup(needed, copies, ["source_key"], "inner", limits, fits_broadcast(ref_map, limits))
        .groupBy("_digest")
        .agg(F.map_from_entries(F.collect_list(F.struct("source_key", "_new"))).alias("_copies"))
    )
    added = ["attachments_copied", "payload_unread"]
    untouched = df.where(~holds).withColumns({c: F.lit(0) for c in added})
    touched = lookup(df.where(holds).withColumn("_digest", digest), per_text, ["_digest"], "left", limits)
    rewritten = touched.withColumn("_out", replace_attachment_refs(F.col(payload), F.col("_copies"), tag)).withColumns(
        {payload: F.col("_out.text"), added[0]: F.col("_out.copied"), added[1]: F.col("_out.unread")}
    )
    return untouched.select(*df.columns, *added).unionByName(rewritten.select(*df.columns, *added))
