"""Corpus statistics, previews and readiness checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import cut


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def length_stats(df: DataFrame, n_tokens: Column | None = None, by: str | None = None) -> DataFrame:
    """Smallest, largest and mean number of tokens; NULLs for an empty input."""
    n = F.size("input_ids") if n_tokens is None else n_tokens
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(n).cast("bigint").alias("min_tokens"),
        F.max(n).cast("bigint").alias("max_tokens"),
        F.avg(n).alias("avg_tokens"),
    )


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def preview(df: DataFrame, row_id: str = "row_id", n: int = 5, width: int = 50) -> DataFrame:
    """The first ``n`` rows by ``row_id``: ``instruction``, else ``text``, else the whole row as JSON, cut short."""
    if "instruction" in df.columns:
        shown = F.col("instruction")
    elif "text" in df.columns:
        shown = F.col("text")
    else:
        shown = F.to_json(F.struct(*df.columns))
    return df.select(row_id, cut(shown, width).alias("preview")).orderBy(row_id).limit(n)


def table_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(check, n_rows, passed)``, one row per table; a table passes when it has rows."""
    checks = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("check"), "n_rows", (F.col("n_rows") > 0).alias("passed")
        )
        checks = row if checks is None else checks.unionByName(row)
    return checks


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("all_passed"))


def size_summary(files: DataFrame) -> DataFrame:
    """``(corpus, n_files, megabytes, passed)`` from ``(corpus, path, length)``; an absent corpus has no path."""
    return files.groupBy("corpus").agg(
        F.count("path").alias("n_files"),
        (F.coalesce(F.sum("length"), F.lit(0)) / 1e6).alias("megabytes"),
        (F.count("path") > 0).alias("passed"),
    )
