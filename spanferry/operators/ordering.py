"""Ordered positions, pages and groups over inputs of any size.

A window without a partition key runs in one task, and a window over a stream key puts a hot stream
into one task. Positions are therefore built from a range partitioning on (stream, key): each
partition numbers its own rows, and only one count per partition is needed to shift them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.shared import settle

# Range partitions are cut so that one holds about this many narrow rows at most.
MAX_SEGMENT_ROWS = 2_000_000

# monotonically_increasing_id() keeps the partition above this bit and the row below it.
_ROW_BITS = 33


def _cut(df: DataFrame, part: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Range-partitioned and sorted ``df`` with ``_seg`` (partition) and ``_row`` (row in partition).

    Settled on shared storage: range bounds are sampled, so counting and numbering must see one cut.
    """
    keys = [*part, *order_by]
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-df.count() // MAX_SEGMENT_ROWS)
    ranged = df.repartitionByRange(needed, *keys) if needed > usual else df.repartitionByRange(*keys)
    tagged = (
        ranged.sortWithinPartitions(*keys)
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    return (
        settle(tagged)
        .withColumn("_seg", F.shiftright("_tag", _ROW_BITS).cast("int"))
        .withColumn("_row", F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_tag")
    )


def segments(df: DataFrame, order_by: Sequence[str], part: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``df`` cut into ordered segments, and the offset of every segment that continues a stream.

    The offsets hold ``(*part, _seg, _before)``: how many rows of the same stream lie in earlier
    segments. Only the first stream of a partition can continue an earlier one, so there is at most
    one row per partition.
    """
    cut = _cut(df, part, order_by)
    counts = cut.groupBy(*part, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    # One row per (stream, partition); without a stream key that is one row per partition.
    earlier = Window.partitionBy(*part).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where("_before > 0")
        .drop("_n")
    )
    return cut, offsets


def positions(
    df: DataFrame, order_by: Sequence[str], part: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in its stream. ``(part, order_by)`` should be unique.

    The rows are settled on shared storage, so pass the key columns and join wide payloads back by key.
    """
    cut, offsets = segments(df, order_by, part)
    if part:
        # A (stream, segment) pair is never larger than one range partition.
        local = Window.partitionBy(*part, "_seg").orderBy("_row")
        numbered = cut.withColumn("_local", F.row_number().over(local).cast("long"))
        keep_null_streams = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in part]
        condition: Column = F.col("l._seg") == F.col("o._seg")
        for equal in keep_null_streams:
            condition = condition & equal
    else:
        numbered = cut.withColumn("_local", F.col("_row") + 1)
        condition = F.col("l._seg") == F.col("o._seg")
    # Broadcast bound: one row per range partition at most (see segments()).
    joined = numbered.alias("l").join(F.broadcast(offsets.alias("o")), condition, "left")
    return joined.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        (F.col("l._local") + F.coalesce(F.col("o._before"), F.lit(0))).alias(name),
    )


def ordered_copy(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows in key order across and within partitions, ready to be written in creation order.

    Give enough key columns to tell rows apart: rows with equal keys share a partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def two_pass_order(df: DataFrame, parent: str, order_by: Sequence[str]) -> DataFrame:
    """Rows without a parent first, then rows with one, each in ``order_by`` order.

    ``create_pass`` is 1 or 2. An empty parent counts as none.
    """
    has_parent = F.col(parent).isNotNull() & (F.col(parent).cast("string") != "")
    tagged = df.withColumn("create_pass", F.when(has_parent, F.lit(2)).otherwise(F.lit(1)))
    return tagged.orderBy("create_pass", *order_by)


def batch_by_count(df: DataFrame, order_by: Sequence[str], n: int, part: Sequence[str] = ()) -> DataFrame:
    """Add ``batch_no`` (from 0): position in the stream divided by ``n``."""
    if n <= 0:
        raise ValueError(f"batch size must be positive; got {n}")
    placed = positions(df, order_by, part, name="_pos")
    return placed.withColumn("batch_no", F.floor((F.col("_pos") - 1) / F.lit(n)).cast("long")).drop("_pos")


def page_cursors(df: DataFrame, key: str, page_size: int) -> DataFrame:
    """Per page of ``page_size`` rows in key order: row count, last key and the key it starts after."""
    if page_size <= 0:
        raise ValueError(f"page size must be positive; got {page_size}")
    pages = (
        batch_by_count(df.select(key), [key], page_size)
        .groupBy(F.col("batch_no").alias("page_no"))
        .agg(F.count(F.lit(1)).alias("page_rows"), F.max(key).alias("last_key"))
    )
    previous = pages.select((F.col("page_no") + 1).alias("page_no"), F.col("last_key").alias("start_after"))
    return pages.join(previous, "page_no", "left").select("page_no", "page_rows", "start_after", "last_key")


def object_groups(df: DataFrame, id_col: str, order_by: Sequence[str], n: int = 25) -> DataFrame:
    """Cut a list of objects into groups of ``n`` and name each group.

    A single object names its own group; larger groups are ``group_`` and the first 12 hex digits of
    the SHA-1 of their ids joined by commas.
    """
    columns = list(dict.fromkeys([id_col, *order_by]))
    placed = positions(df.select(*columns), order_by, name="_pos")
    # A group never holds more than n ids.
    grouped = (
        placed.withColumn("group_no", F.floor((F.col("_pos") - 1) / F.lit(n)).cast("long"))
        .groupBy("group_no")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(id_col).cast("string").alias("id")))).alias("_ids"))
        .select("group_no", F.transform("_ids", lambda x: x["id"]).alias("object_ids"))
    )
    digest = F.substring(F.sha1(F.encode(F.array_join("object_ids", ","), "utf-8")), 1, 12)
    return grouped.withColumn(
        "group_name",
        F.when(F.size("object_ids") == 1, F.col("object_ids")[0]).otherwise(F.concat(F.lit("group_"), digest)),
    )
