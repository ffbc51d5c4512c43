"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse, which a cluster shares as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, purpose: str, options: dict[str, int] | None = None) -> DataFrame:
    """The rows, written once: whatever is built on them reads the table, and a lost executor costs no recomputation."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.options(**(options or {})).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
