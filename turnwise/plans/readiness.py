"""Is everything there before training starts?"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.operators.stats import all_passed, table_checks
from turnwise.sources.inventory import corpus_sizes


def readiness(spark: SparkSession, folders: Mapping[str, str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(check, passed)``: one row per corpus folder (has files) and per table (has rows)."""
    present = corpus_sizes(spark, folders).select(F.concat(F.lit("files:"), "corpus").alias("check"), "passed")
    if not tables:
        return present
    return present.unionByName(
        table_checks(tables).select(F.concat(F.lit("rows:"), "check").alias("check"), "passed")
    )


def ready(spark: SparkSession, folders: Mapping[str, str], tables: Mapping[str, DataFrame]) -> DataFrame:
    return all_passed(readiness(spark, folders, tables))
