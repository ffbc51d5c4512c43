"""Scoring raw predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.text import joined_shots, normalise_answer
from turnwise.operators.ordering import seeded_hash


def accuracy(df: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    """Mean of a 0/1 column, its standard error and the sample count. Partial aggregates only."""
    return df.groupBy(*by).agg(
        F.avg(correct).alias("acc"),
        (F.stddev_samp(correct) / F.sqrt(F.count(correct))).alias("acc_stderr"),
        F.count(correct).alias("n"),
    )


def best_choice(scores: Column) -> Column:
    """Zero-based position of the highest score; the first one on a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def per_length(scores: Column, choices: Column) -> Column:
    """Scores divided by the length of their choice, in characters. An empty choice has no such score and is never best."""
    return F.zip_with(scores, choices, lambda s, c: F.try_divide(s, F.length(c)))


def multiple_choice(df: DataFrame, scores: str = "scores", choices: str = "choices", gold: str = "gold") -> DataFrame:
    """Adds ``acc`` and the length-normalised ``acc_norm`` per row, both 0.0 or 1.0."""
    plain = best_choice(F.col(scores)) == F.col(gold)
    normalised = best_choice(per_length(F.col(scores), F.col(choices))) == F.col(gold)
    return df.withColumns({"acc": plain.cast("double"), "acc_norm": normalised.cast("double")})


def exact_match(prediction: Column, target: Column) -> Column:
    """1.0 when both sides are equal after normalisation, else 0.0; a missing prediction is wrong."""
    same = normalise_answer(prediction) == normalise_answer(target)
    return F.coalesce(same, F.lit(False)).cast("double")


def limit_per_task(
    df: DataFrame, n: int, task: str = "task", order: str = "doc_id", salts: int = 256
) -> DataFrame:
    """The first ``n`` rows of each task.

    A task may hold most of the table, so it is first cut to ``n`` rows in each of ``salts`` slices; the second rank
    sees at most ``n * salts`` rows per task. For small ``n`` Spark also cuts before each shuffle.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(order, F.spark_partition_id()), F.lit(salts)))
    in_slice = F.row_number().over(Window.partitionBy(task, "_slice").orderBy(order))
    in_task = F.row_number().over(Window.partitionBy(task).orderBy(order))
    return (
        sliced.withColumn("_rank", in_slice).filter(F.col("_rank") <= n).drop("_rank", "_slice")
        .withColumn("_rank", in_task).filter(F.col("_rank") <= n).drop("_rank")
    )


def sample_counts(df: DataFrame, limited: DataFrame, task: str = "task") -> DataFrame:
    """Rows per task before and after a limit."""
    before = df.groupBy(task).agg(F.count(F.lit(1)).alias("original"))
    after = limited.groupBy(task).agg(F.count(F.lit(1)).alias("effective"))
    return before.join(after, task, "left").select(
        task, "original", F.coalesce("effective", F.lit(0)).alias("effective")
    )


def shots_context(train: DataFrame, shots: int, row_id: str, example: str, seed: int = 42) -> DataFrame:
    """One row, one column: ``shots`` training examples in seeded order, joined by blank lines.

    A top-k: every task keeps ``shots`` rows, and only those meet.
    """
    chosen = (
        train.select(seeded_hash(F.col(row_id), seed).alias("h"), F.col(example).alias("example"))
        .orderBy("h")
        .limit(shots)
    )
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("h", "example"))), lambda s: s["example"])
    return chosen.agg(joined_shots(in_order).alias("context"))


def with_context(df: DataFrame, context: DataFrame, prompt: str, out: str = "prompt") -> DataFrame:
    """Puts the shared context in front of each prompt. The context is a scalar subquery, not a join."""
    return df.withColumn(out, F.concat(context.scalar(), F.lit("\n\n"), F.col(prompt)))
