"""Positions of rows: in a seeded order over a key, computed without a global sort, and in any given order.

The seeded order is that of ``md5(row_id - seed)``. Its hex prefix spreads any key evenly over buckets whose bounds are known
in advance, so positions are bucket offsets (a small aggregate) plus ranks inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.sources.kept import kept_table

PREFIX = 4  # hex digits: 65,536 buckets


def seeded_hash(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", row_id.cast("string"), F.lit(str(seed))))


def bucket_totals(df: DataFrame, key: Column, prefix: int = PREFIX) -> DataFrame:
    """``(bucket, n, before)``: rows per bucket and rows in earlier buckets. At most ``16**prefix`` rows."""
    if not 1 <= prefix <= 5:
        raise ValueError("the prefix is 1 to 5 hex digits, which bounds the totals to 1,048,576 rows")
    totals = df.groupBy(F.substring(key, 1, prefix).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return totals.withColumn("before", F.coalesce(running, F.lit(0)))


def seeded_index(df: DataFrame, row_id: str, seed: int = 42, prefix: int = PREFIX) -> DataFrame:
    """``(row_id, index)``: dense positions 0..n-1 in seeded order. ``row_id`` must be unique.

    One shuffle of the key column only; the bucket totals have a fixed maximum size and are broadcast.
    """
    keyed = df.select(row_id).withColumn("h", seeded_hash(F.col(row_id), seed))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, prefix))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h"))
    totals = bucket_totals(df.select(row_id), seeded_hash(F.col(row_id), seed), prefix).drop("n")
    return (
        keyed.withColumn("rank", rank)
        .join(F.broadcast(totals), "bucket")
        .select(row_id, (F.col("before") + F.col("rank") - 1).alias("index"))
    )


def dense_positions(df: DataFrame, order: Sequence[Column], name: str = "position", purpose: str = "ordered") -> DataFrame:
    """The rows with their places 0..n-1 in an order without ties, whatever the values look like.

    The rows are dealt to ranges of equal size, which Spark finds by sampling, sorted there and written once, each with
    its range and its place in it. Only the sizes of the ranges meet in one task. Rows that tie may stand either way.
    """
    ordered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = kept_table(ordered, purpose).withColumn("_range", F.shiftrightunsigned("_at", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))  # as many rows as there were tasks
    before = sizes.select("_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_at", "_before")
