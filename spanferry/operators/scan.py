"""Keyset pages and object scans over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spanferry.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, lookup
from spanferry.operators.project import created_between

# Up to this many ids are pushed into the scan as a filter; more become a join.
MAX_FILTER_IDS = 1_000


def keyset_range(
    df: DataFrame,
    key: str,
    after: object | None = None,
    inclusive: bool = False,
    created_col: str = "created",
    created_after: object | None = None,
    created_before: object | None = None,
) -> DataFrame:
    """All rows after a key and inside a created range; every bound reaches the scan."""
    if created_after not in (None, "") or created_before not in (None, ""):
        df = created_between(df, created_col, created_after, created_before)
    if after not in (None, ""):
        bound = F.lit(after).cast(df.schema[key].dataType)
        df = df.where(F.col(key) >= bound if inclusive else F.col(key) > bound)
    return df


def keyset_page(
    df: DataFrame,
    key: str,
    limit: int,
    after: object | None = None,
    inclusive: bool = False,
    created_col: str = "created",
    created_after: object | None = None,
    created_before: object | None = None,
    select: Sequence[str] | str = "*",
) -> DataFrame:
    """One page in key order: a top-``limit`` over the range, without a full sort."""
    ranged = keyset_range(df, key, after, inclusive, created_col, created_after, created_before)
    columns = [select] if isinstance(select, str) else list(select)
    return ranged.orderBy(key).limit(limit).select(*columns)


def start_key(df: DataFrame, key: str, created_after: object, created_col: str = "created") -> DataFrame:
    """One row: the smallest key created at or after a time, null when there is none."""
    return created_between(df, created_col, created_after).agg(F.min(key).alias("start_key"))


def scan_objects(
    df: DataFrame, id_col: str, ids: Sequence[object] | DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Rows of several objects in one scan; ``ids`` is a list or a DataFrame with the ids in its first column."""
    if not isinstance(ids, DataFrame):
        if len(ids) <= MAX_FILTER_IDS:
            return df.where(F.col(id_col).isin(list(ids)))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], [id_col])
    wanted = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    small = fits_broadcast(ids.select(ids.columns[0]), limits)
    return lookup(df, wanted, [id_col], "left_semi", limits, small).select(*df.columns)
