"""Session defaults the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Settled intermediate results are written with this serializer; rows are far smaller and faster in it.
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.checkpoint.compress": "true",
    # Settled intermediate results are removed from the shared folder once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Resumable jobs overwrite only the partition of the epoch they replay.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "spanferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` where Spark uses a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
