"""Evaluation results: one metric per task and model, compared across stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions import result_json
from turnwise.functions.text import percent_or_na, signed_points

STAGES = ("base", "sft", "dpo")  # fixed values: stage names in training order


def latest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key with the greatest ``order``; later columns break ties of earlier ones."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("newest")).select(key, "newest.*")


def latest_results(files: DataFrame) -> DataFrame:
    """Newest result document per model from ``(model, modified, body)``; equal times go by the date in the body, and
    equal dates by the path where there is one."""
    order = [F.col("modified"), result_json.run_date(F.col("body"))]
    if "path" in files.columns:
        order.append(F.col("path"))
    return latest_per(files, "model", *order)


def extract_metrics(results: DataFrame, preferred: Sequence[str] = result_json.PRIMARY_METRICS) -> DataFrame:
    """``(model, task, value)`` from ``(model, body)``. Tasks without any metric are left out."""
    tasks = results.select("model", F.explode(result_json.task_results(F.col("body"))).alias("task", "metrics"))
    return tasks.filter(result_json.has_primary_metric(F.col("metrics"), preferred)).select(
        "model", "task", result_json.primary_metric(F.col("metrics"), preferred).alias("value")
    )


def extract_sample_counts(results: DataFrame) -> DataFrame:
    """``(model, task, original, effective)`` from ``(model, body)``."""
    return results.select(
        "model", F.explode(result_json.sample_counts(F.col("body"))).alias("task", "counts")
    ).select("model", "task", "counts.original", "counts.effective")


def side_by_side(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """One row per task with a column per stage: the full outer join of the stages, in one shuffle.

    A conditional maximum per stage does what a pivot would do with two.
    """
    known = metrics.filter(F.col("model").isin(*stages))
    return known.groupBy("task").agg(*[F.max(F.when(F.col("model") == s, F.col("value"))).alias(s) for s in stages])


def _points(after: str, before: str) -> Column:
    return (F.col(after) - F.col(before)) * 100


def comparison(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Values per stage and the difference to the stage before, in points; NULL where a side is missing."""
    wide = side_by_side(metrics, stages)
    gains = [_points(b, a).alias(f"{b}_vs_{a}") for a, b in zip(stages, stages[1:])]
    return wide.select("task", *stages, *gains)


def comparison_text(compared: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """The comparison as display strings."""
    values = [percent_or_na(F.col(s)).alias(s) for s in stages]
    gains = [
        F.coalesce(signed_points(F.col(f"{b}_vs_{a}")), F.lit("")).alias(f"{b}_vs_{a}")
        for a, b in zip(stages, stages[1:])
    ]
    return compared.select("task", *values, *gains)


def sorted_tasks(compared: DataFrame) -> DataFrame:
    return compared.orderBy("task")


def complete_tasks(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Tasks every stage has, as percentages. Tasks some stage lacks are in :func:`incomplete_tasks`."""
    wide = side_by_side(metrics, stages).dropna(subset=list(stages))
    return wide.select("task", *[(F.col(s) * 100).alias(s) for s in stages])


def incomplete_tasks(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Tasks of the first stage that another stage lacks."""
    lacking = F.lit(False)
    for s in stages[1:]:
        lacking = lacking | F.col(s).isNull()
    return side_by_side(metrics, stages).filter(F.col(stages[0]).isNotNull() & lacking)


def stage_gains(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """``(task, model, value, gain)``: gain in points over the same task's previous recorded stage."""
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("model"))
    earlier = F.lag("value").over(Window.partitionBy("task").orderBy("stage_no"))
    return (
        metrics.withColumn("stage_no", number)
        .filter(F.col("stage_no") > 0)
        .withColumn("gain", (F.col("value") - earlier) * 100)
        .select("task", "model", "value", "gain")
    )


def model_averages(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """``(model, average)``, missing values skipped; a stage without any value has average 0."""
    sums = [F.coalesce(F.avg(F.when(F.col("model") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in stages]
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("average")) for s in stages]))
    return metrics.agg(*sums).select(pairs.alias("pair")).select("pair.*")


def mean_points(metrics: DataFrame) -> DataFrame:
    """``(model, points)``: plain mean over the benchmarks, times 100."""
    return metrics.groupBy("model").agg((F.avg("value") * 100).alias("points"))


def average_gains(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Mean points per stage and the gain over the stage before; one row per stage."""
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("model"))
    earlier = F.lag("points").over(Window.orderBy("stage_no"))
    return (
        mean_points(metrics)
        .withColumn("stage_no", number)
        .filter(F.col("stage_no") > 0)
        .withColumn("gain", F.col("points") - earlier)
        .select("stage_no", "model", "points", "gain")
    )


def tasks_per_model(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model").agg(F.count(F.lit(1)).alias("n_tasks"))


def task_names(metrics: DataFrame) -> DataFrame:
    """The union of the task names of all stages."""
    return metrics.select("task").distinct()
