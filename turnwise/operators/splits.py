"""Train/validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.operators.ordering import PREFIX, bucket_totals, seeded_hash

TRAIN, VALIDATION = "train", "validation"


def _named(in_validation: Column) -> Column:
    return F.when(in_validation, F.lit(VALIDATION)).otherwise(F.lit(TRAIN))


def validation_cut(df: DataFrame, row_id: str, test_size: float, seed: int, prefix: int = PREFIX) -> DataFrame:
    """One row: the largest seeded hash that still belongs to the validation part (NULL when that part is empty).

    A histogram of hash prefixes finds the bucket in which the boundary lies; only that bucket is looked at row by
    row, and its equal hashes are counted before they are ordered.
    """
    h = seeded_hash(F.col(row_id), seed)
    totals = bucket_totals(df.select(row_id), h, prefix)
    all_buckets = Window.partitionBy()  # at most 16**prefix rows
    need = F.ceil(F.sum("n").over(all_buckets) * F.lit(test_size))
    boundary = (
        totals.withColumn("need", need)
        .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        .select("bucket", (F.col("need") - F.col("before")).alias("inside"))
    )
    inside = (
        df.select(h.alias("h"))
        .withColumn("bucket", F.substring("h", 1, prefix))
        .filter(F.col("bucket") == boundary.select("bucket").scalar())
        .groupBy("bucket", "h")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("h"))
    reached = inside.withColumn("upto", upto).filter(F.col("upto") >= boundary.select("inside").scalar())
    return reached.agg(F.min("h").alias("cut"))


def exact_split(
    df: DataFrame,
    row_id: str = "row_id",
    test_size: float = 0.02,
    seed: int = 42,
    prefix: int = PREFIX,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split``; validation is the ``ceil(n * test_size)`` rows that come first in seeded order.

    The rows themselves do not move: the boundary is a scalar subquery over the key column, the assignment a
    comparison. The same rows are chosen whatever the partitioning. The key column is read twice for the boundary;
    where the rows of ``df`` are costly to find, ``keys`` is a table of their keys.
    """
    cut = validation_cut(df if keys is None else keys, row_id, test_size, seed, prefix)
    return df.withColumn("split", _named(F.coalesce(seeded_hash(F.col(row_id), seed) <= cut.scalar(), F.lit(False))))


def hash_split(df: DataFrame, row_id: str = "row_id", test_size: float = 0.02, seed: int = 42) -> DataFrame:
    """Adds ``split`` by a threshold on the hash: row by row, so the part sizes are approximate."""
    lead = F.conv(F.substring(seeded_hash(F.col(row_id), seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", _named(lead / F.lit(float(1 << 32)) < test_size))


def preference_split(df: DataFrame, row_id: str = "row_id", test_size: float = 0.02, seed: int = 42) -> DataFrame:
    """Keeps a ``split`` column that is already there, otherwise splits exactly."""
    return df if "split" in df.columns else exact_split(df, row_id, test_size, seed)
