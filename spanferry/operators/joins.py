"""Key lookups that stay balanced whatever the key distribution.

All joins in this library are equality lookups against a side that holds each key once. Two things
can go wrong at scale, and both are handled here once for every caller:

* the looked-up side is only broadcast after its rows and bytes were measured against a fixed bound;
* when it is too large for that, keys that hold a noticeable share of the probing rows are found with
  a frequency sketch (one row to the driver) and only those keys are salted, so no task receives a
  whole hot key and the looked-up side grows by at most (hot keys x salts) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class JoinLimits:
    """Bounds for broadcasting and salting.

    A key is hot when it holds at least ``hot_share`` of the probing rows, so there are at most
    ``1 / hot_share`` hot keys; the sketch tracks many more keys than that, so it misses none of them.
    """

    max_rows: int = 500_000
    max_bytes: int = 32 * 1024 * 1024
    salts: int = 32
    hot_share: float = 0.001
    tracked_keys: int = 16_384


DEFAULT_LIMITS = JoinLimits()

_HASHABLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with every nested field nullable, so that any value can be cast to it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, nullable(kind.valueType), True)
    return kind


def _row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a row, counting variable-length columns exactly."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
        else:
            total = total + 16
    return total


def fits_broadcast(df: DataFrame, limits: JoinLimits = DEFAULT_LIMITS) -> bool:
    """Measure ``df`` and tell whether it is within the broadcast bound."""
    return fits_broadcast_each(df, [F.lit(True)], limits)[0]


def fits_broadcast_each(df: DataFrame, parts: list[Column], limits: JoinLimits = DEFAULT_LIMITS) -> list[bool]:
    """:func:`fits_broadcast` for each part of ``df``, given as a condition on its rows, from one pass."""
    sizes = [F.struct(F.count_if(p).alias("n"), F.sum(F.when(p, _row_bytes(df))).alias("b")).alias(f"p{i}") for i, p in enumerate(parts)]
    measured = df.agg(*sizes).first()
    return [size["n"] <= limits.max_rows and (size["b"] or 0) <= limits.max_bytes for size in measured]


def hot_keys_each(df: DataFrame, keys: list[list[str]], limits: JoinLimits = DEFAULT_LIMITS) -> list[list[int]]:
    """:func:`hot_keys` for each of several keys of one table, from one pass over all of them."""
    most = int(1 / limits.hot_share)
    hashes = [f"xxhash64({', '.join(f'`{c}`' for c in on)})" for on in keys]
    tops = [F.expr(f"approx_top_k({h}, {most}, {limits.tracked_keys})").alias(f"top{i}") for i, h in enumerate(hashes)]
    found = df.agg(*tops, F.count(F.lit(1)).alias("n")).first()
    floor = max(found["n"] * limits.hot_share, 2)
    return [[entry["item"] for entry in found[f"top{i}"] if entry["count"] >= floor] for i in range(len(keys))]


def hot_keys(df: DataFrame, on: list[str], limits: JoinLimits = DEFAULT_LIMITS) -> list[int]:
    """Hashes of the keys that hold at least ``hot_share`` of ``df``, from one pass over the key columns."""
    return hot_keys_each(df, [on], limits)[0]


def _spread(df: DataFrame, limits: JoinLimits) -> Column:
    # A function of the row and its partition, never of row order: a re-run task salts identically.
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, _HASHABLE)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(limits.salts)).cast("int")


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    limits: JoinLimits = DEFAULT_LIMITS,
    small: bool | None = None,
    keys_of: DataFrame | None = None,
    hot: list[int] | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on the shared columns ``on``; ``right`` holds each key at most once.

    ``how`` is one of ``left``, ``inner``, ``left_semi`` and ``left_anti``. Null keys never match.
    ``small`` passes on the outcome of :func:`fits_broadcast` for ``right`` or a superset of it, and
    ``keys_of`` a cheaper input with the same key columns as ``left`` (a table that ``left`` extends),
    in which hot keys are looked for instead of running ``left`` once more. ``hot`` passes on hot keys that are known.
    """
    if fits_broadcast(right, limits) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    if hot is None:
        hot = hot_keys(left if keys_of is None else keys_of, on, limits)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.xxhash64(*[F.col(f"`{c}`") for c in on]).isin(hot)
    salted_left = left.withColumn("_salt", F.when(is_hot, _spread(left, limits)).otherwise(F.lit(0)))
    every_salt = F.sequence(F.lit(0), F.lit(limits.salts - 1))
    salted_right = right.withColumn("_salt", F.explode(F.when(is_hot, every_salt).otherwise(F.array(F.lit(0)))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
