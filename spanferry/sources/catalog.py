"""Stored tables and listings of stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanferry.sources.schemas import schema_of


def read_table(spark: SparkSession, path: str, kind: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored table (``parquet``, ``orc`` or ``json`` lines), with the fixed schema of its kind if given.

    Filters and column selection reach the files. JSON needs a kind, so that nothing is inferred.
    """
    if fmt == "json" and kind is None:
        raise ValueError("reading JSON needs the kind of table")
    reader = spark.read.format(fmt)
    return (reader if kind is None else reader.schema(schema_of(kind))).load(path)


def list_catalog(
    df: DataFrame, project_id: object | None = None, filter_field: str = "project_id", object_type: str | None = None
) -> DataFrame:
    """All objects of a type, optionally of one project.

    Views are listed by ``filter_field='object_id'`` with ``object_type='project'``; types that belong
    to the whole organisation are listed without a project.
    """
    if project_id is None:
        return df
    df = df.where(F.col(filter_field) == F.lit(project_id).cast(df.schema[filter_field].dataType))
    return df if object_type is None else df.where(F.col("object_type") == object_type)
