"""Shared storage used to cut lineage and to hold side tables.

Everything here lives in the folder named by ``spark.checkpoint.dir``, which every executor can reach,
so a lost executor never takes intermediate results with it. Only a local-mode session without that
setting falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spanferry-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/spanferry-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from there with a short lineage and a size estimate that fits 64 bits."""
    shared_dir(df.sparkSession)
    return _of_plain_size(df.checkpoint(eager=True))


UNKNOWN_SIZE = 2**63 - 1  # bytes, as Spark takes a table of which it knows nothing


def _of_plain_size(settled: DataFrame) -> DataFrame:
    """``settled``; where Spark's estimate of its bytes is beyond ``UNKNOWN_SIZE``, as a table of unknown size.

    Spark estimates a join as the product of its sides, and a checkpoint keeps the estimate. Through rounds of settled joins
    its digits double, or more, each round: numbers of hundreds of megabytes, in the driver, that say nothing.
    """
    spark, plan = settled.sparkSession, settled._jdf.queryExecution().logical()
    try:
        plain = plan.stats().sizeInBytes() <= UNKNOWN_SIZE
    except ValueError:  # too many digits for Python to read
        plain = False
    if plain:
        return settled
    option, session = spark._jvm.scala.Option, spark._jsparkSession
    plan = plan.copy(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        session, option.empty(), option.apply(plan.constraints()),
    )
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Eager steps inside send at most ``rows`` rows at once to Python; the session's own setting holds again afterwards.

    A batch is held whole by the executor, outside its heap and with room to grow, and by the Python worker.
    Spark's 10,000 whole texts are tens of megabytes a task on each side.
    """
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The parquet rows stored at ``path``; None when the folder does not exist.

    The schema is given, not inferred, so a folder left behind by a first attempt that failed reads as empty.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stored_keys(like: DataFrame, path: str, ids: Sequence[str], batch_col: str, before: int) -> DataFrame | None:
    """Ids already stored at ``path`` by batches earlier than ``before``; None when nothing is stored.

    Only the id columns of the earlier batches are scanned.
    """
    schema = T.StructType([*[like.schema[c] for c in ids], T.StructField(batch_col, T.LongType())])
    stored = read_stored(like.sparkSession, path, schema)
    return None if stored is None else stored.where(F.col(batch_col) < before).select(*ids)
