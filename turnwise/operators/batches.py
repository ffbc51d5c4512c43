"""Batches of rows, padded to their longest member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.operators.labels import IGNORE_INDEX
from turnwise.operators.ordering import PREFIX, seeded_index
from turnwise.operators.tokens import SpecialIds

# --- fixed values: rows per device, devices, accumulation steps of the two training stages ---
INSTRUCTION_BATCH = (4, 4, 8)
PREFERENCE_BATCH = (1, 4, 32)
# ----------------------------------------------------------------------------------------------


def effective_batch(per_device: int, devices: int, accumulation: int) -> int:
    return per_device * devices * accumulation


def assign_batches(
    df: DataFrame, row_id: str = "row_id", batch_size: int = 128, seed: int = 42, prefix: int = PREFIX
) -> DataFrame:
    """Adds ``batch_id``: consecutive runs of ``batch_size`` rows in seeded order; only the last may be short.

    The order is worked out on the key alone, so the wide rows are shuffled once, by key, to receive their number.
    ``df`` is best a written table: its key column is read two more times.
    """
    index = seeded_index(df, row_id, seed, prefix)
    numbered = index.select(row_id, F.call_function("div", F.col("index"), F.lit(batch_size)).alias("batch_id"))
    return df.join(numbered, row_id)


def padded_batches(
    df: DataFrame, special: SpecialIds, side: str = "right", row_id: str = "row_id", batch_size: int = 128,
    seed: int = 42, prefix: int = PREFIX,
) -> DataFrame:
    """Rows with their ``batch_id``, padded: as :func:`assign_batches` and :func:`pad_batches`, with one wide shuffle.

    Numbers and widths of the batches are worked out on keys and sizes; the wide rows are shuffled once, by key, to
    receive them. ``df`` is best a written table: its keys and sizes are read before.
    """
    sizes = df.select(row_id, F.size("input_ids").alias("_size"), F.size("labels").alias("_label_size"))
    index = seeded_index(df, row_id, seed, prefix).join(sizes, row_id)
    members = Window.partitionBy("batch_id")
    placed = index.select(
        row_id, "_size", "_label_size", F.call_function("div", F.col("index"), F.lit(batch_size)).alias("batch_id")
    ).withColumns({"_width": F.max("_size").over(members), "_label_width": F.max("_label_size").over(members)})
    return _filled(df.join(placed.drop("_size", "_label_size"), row_id), special, side)


def _padded(values: Column, fill: int, width: Column, side: str) -> Column:
    gap = F.array_repeat(F.lit(fill), (width - F.size(values)).cast("int"))
    return F.concat(gap, values) if side == "left" else F.concat(values, gap)


def pad_batches(
    df: DataFrame, special: SpecialIds, side: str = "right", batch: str = "batch_id"
) -> DataFrame:
    """Pads ids, mask and labels of each batch to its longest row; labels with the ignored label.

    ``side`` is ``right`` for instruction tuning and ``left`` for preference tuning. Label lists are measured on their
    own, as they may be longer than the ids. A batch holds ``batch_size`` rows, which bounds the window.
    """
    members = Window.partitionBy(batch)
    width = F.max(F.size("input_ids")).over(members)
    label_width = F.max(F.size("labels")).over(members)
    return _filled(df.withColumns({"_width": width, "_label_width": label_width}), special, side)


def _filled(measured: DataFrame, special: SpecialIds, side: str) -> DataFrame:
    if side not in ("left", "right"):
        raise ValueError(f"padding side must be left or right, not {side}")
    return measured.withColumns(
        {
            "input_ids": _padded(F.col("input_ids"), special.pad_id, F.col("_width"), side),
            "attention_mask": _padded(F.col("attention_mask"), 0, F.col("_width"), side),
            "labels": _padded(F.col("labels"), IGNORE_INDEX, F.col("_label_width"), side),
        }
    ).drop("_width", "_label_width")
