"""Reading one metric per task out of evaluation result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- fixed values: metric keys in order of preference, and the key prefix that is never a metric
PRIMARY_METRICS = ("acc,none", "acc_norm,none", "exact_match,none", "pass@1,none")
NOT_A_METRIC = "alias"
# ------------------------------------------------------------------------------------------------

TASK_MAP = "struct<results:map<string,map<string,variant>>>"
SAMPLE_MAP = "struct<`n-samples`:map<string,struct<original:bigint,effective:bigint>>>"


def task_results(body: Column) -> Column:
    """``task -> metric key -> value``, keeping document order and JSON types."""
    return F.from_json(body, TASK_MAP)["results"]


def sample_counts(body: Column) -> Column:
    return F.from_json(body, SAMPLE_MAP)["n-samples"]


def run_date(body: Column) -> Column:
    """Epoch seconds of the run, NULL when the document has none."""
    return F.get_json_object(body, "$.date").try_cast("double")


def run_time(body: Column) -> Column:
    """The time of the run, from its epoch seconds, to the microsecond."""
    return F.timestamp_micros(F.round(run_date(body) * 1_000_000).cast("bigint"))


def is_number(v: Column) -> Column:
    """Number or boolean in the JSON sense; a quoted number is text."""
    kind = F.schema_of_variant(v)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def as_double(v: Column) -> Column:
    return F.when(
        F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")
    ).otherwise(F.try_variant_get(v, "$", "double"))


def _fallback(metrics: Column) -> Column:
    """First numeric entry in document order whose key is not an alias."""
    numeric = F.filter(
        F.map_entries(metrics),
        lambda e: is_number(e["value"]) & ~F.startswith(e["key"], F.lit(NOT_A_METRIC)),
    )
    return F.try_element_at(numeric, F.lit(1))["value"]


def primary_metric(metrics: Column, preferred: Sequence[str] = PRIMARY_METRICS) -> Column:
    """The preferred key that comes first, else the first numeric entry.

    ``metrics`` is one task's ``map<string,variant>``; the choice is made inside the row, without a shuffle.
    """
    picked = as_double(_fallback(metrics))
    for key in reversed(preferred):
        picked = F.when(
            F.map_contains_key(metrics, F.lit(key)), as_double(F.try_element_at(metrics, F.lit(key)))
        ).otherwise(picked)
    return picked


def has_primary_metric(metrics: Column, preferred: Sequence[str] = PRIMARY_METRICS) -> Column:
    """True when the task has a preferred key (even a null one) or any numeric entry."""
    named = F.arrays_overlap(F.map_keys(metrics), F.array(*[F.lit(k) for k in preferred]))
    return named | _fallback(metrics).isNotNull()
