"""Joins in which a few key values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PARTS = 256  # a key is hot if at least this part of the rows have it, so at most so many are
SALTS = 32


def hot_keys(rows: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """The key values that at least ``1 / parts`` of the rows have: at most ``parts`` rows, counted with partial sums."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    share = max(-(-rows.select(*keys).count() // parts), 2)
    found = counted.filter(F.col("_held") >= share).select(*keys)
    return rows.sparkSession.createDataFrame(found.collect(), found.schema)


def hot_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    null_safe: bool = False,
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` with the columns of ``table``; the rows of a hot key are dealt over ``salts`` parts of it.

    Only the table's rows of hot keys are repeated, once a part, whatever their size; nothing but the hot keys is
    broadcast. The part of a row depends on its content, so a repeated task deals it alike. With ``null_safe`` a NULL key
    meets a NULL key.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    # a struct of the keys is equal to another one if its fields are, NULL or not
    key, on = F.struct(*keys), ["_key", "_part"]
    marked = F.broadcast(hot.select(key.alias("_key"), F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_key", key).join(marked, "_key", "left").withColumn("_part", part).drop("_hot")
    right = table.withColumn("_key", key).join(marked, "_key", "left").withColumn("_part", F.explode(parts)).drop("_hot")
    if not null_safe:
        left, right, on = left.drop("_key"), right.drop("_key"), [*keys, "_part"]
        return left.join(right, on, how).drop("_part")
    return left.join(right.drop(*keys), on, how).drop(*on)
