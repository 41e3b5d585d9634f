"""Row predicates over nested columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_code_bundle(function_type: Column, data_type: Column) -> Column:
    """Whether a function is code that only references a build artifact.

    Code is portable when its data is ``inline``; missing data counts as a bundle. Functions that are
    not code are never bundles. Pass ``function_data.type`` and ``function_data.data.type``.
    """
    inline = F.coalesce(data_type == "inline", F.lit(False))
    return F.coalesce(function_type == "code", F.lit(False)) & ~inline


def is_tombstone(flag: Column) -> Column:
    """Strictly true; null is not a tombstone."""
    return flag.eqNullSafe(F.lit(True))
