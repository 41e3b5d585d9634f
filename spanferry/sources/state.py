"""Stream state: one row per (stream, epoch), written with the batch it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from spanferry.shared import read_stored

COUNTERS = (
    "fetched", "inserted", "inserted_bytes", "skipped_deleted", "skipped_seen", "attachments_copied", "spilled_fields",
    "quarantined",
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("last_key", T.StringType()),
        T.StructField("created_after", T.StringType()),
        T.StructField("created_before", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
    ]
)

# The epoch of a stream that never committed.
NO_EPOCH = -1


def write_state(state: DataFrame, path: str) -> None:
    """Write state rows; a replayed epoch replaces its own row and nothing else."""
    columns = [
        (F.col(f.name) if f.name in state.columns else F.lit(0 if f.name in COUNTERS else None)).cast(f.dataType).alias(f.name)
        for f in STATE_SCHEMA.fields
    ]
    (
        state.select(*columns)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stream", "epoch")
        .parquet(path)
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Every committed state row; empty when nothing was committed yet."""
    stored = read_stored(spark, path, STATE_SCHEMA)
    return spark.createDataFrame([], STATE_SCHEMA) if stored is None else stored.select(*STATE_SCHEMA.names)


def read_state(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """The latest state of a stream in one row; zeros and nulls when it never committed."""
    values = [stream, NO_EPOCH, None, None, None, *[0] * len(COUNTERS)]
    default = spark.createDataFrame([tuple(values)], STATE_SCHEMA)
    committed = read_states(spark, path).where(F.col("stream") == stream)
    ordered = F.struct("epoch", *[c for c in STATE_SCHEMA.names if c != "epoch"])
    latest = committed.unionByName(default).agg(F.max_by(ordered, F.col("epoch")).alias("s"))
    return latest.select(*[F.col(f"s.{c}") for c in STATE_SCHEMA.names])


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed row of every stream."""
    ordered = F.struct("epoch", *[c for c in STATE_SCHEMA.names if c not in ("stream", "epoch")])
    latest = read_states(spark, path).groupBy("stream").agg(F.max_by(ordered, F.col("epoch")).alias("s"))
    return latest.select("stream", *[F.col(f"s.{c}") for c in STATE_SCHEMA.names if c != "stream"])


def guard_filters(state: Row | DataFrame, created_after: str | None, created_before: str | None) -> None:
    """Refuse to resume with other time filters than the state was written with.

    A state without a filter adopts the one given now; a state with one must be given the same again.
    """
    row = state.first() if isinstance(state, DataFrame) else state
    for name, now in (("created_after", created_after), ("created_before", created_before)):
        if now is not None and not (isinstance(now, str) and now):
            raise TypeError(f"{name} must be a non-empty string when set")
        then = row[name] if row is not None else None
        if then is not None and now != then:
            raise ValueError(f"{name} differs from the stored state: stored {then!r}, now {now!r}")
