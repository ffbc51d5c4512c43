"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnwise.operators.labels import MAX_SEQ_LENGTH
from turnwise.operators.tokens import Encoder

# --- fixed values: the full benchmark list -----------------------------------------------------
ALL_TASKS = (
    "mmlu", "hellaswag", "arc_challenge", "winogrande", "piqa", "gsm8k", "humaneval", "ifeval", "commonsense_qa",
)
# --- fixed values: token budgets of preference training ----------------------------------------
MAX_PROMPT_LENGTH = 1024
MAX_PAIR_LENGTH = 2048
# ------------------------------------------------------------------------------------------------


def within_length(df: DataFrame, max_seq_length: int = MAX_SEQ_LENGTH, ids: str = "input_ids") -> DataFrame:
    """Rows of at most ``max_seq_length`` ids. Never drops a row that was cut to that length before."""
    return df.filter(F.size(ids) <= max_seq_length)


def overlong_count(df: DataFrame, max_seq_length: int = MAX_SEQ_LENGTH, ids: str = "input_ids") -> DataFrame:
    """Rows before the filter and rows it removes, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size(ids) > max_seq_length).alias("n_dropped"),
    )


def preference_budget(
    triples: DataFrame,
    encoder: Encoder,
    max_prompt_length: int = MAX_PROMPT_LENGTH,
    max_length: int = MAX_PAIR_LENGTH,
) -> DataFrame:
    """Adds token counts and whether the prompt, and the prompt with each answer, fit their budgets."""
    counted = triples.withColumns(
        {f"{c}_tokens": encoder.count(F.col(c)).cast("bigint") for c in ("prompt", "chosen", "rejected")}
    )
    longer = F.greatest("chosen_tokens", "rejected_tokens")
    return counted.withColumns(
        {
            "prompt_fits": F.col("prompt_tokens") <= max_prompt_length,
            "pair_fits": F.col("prompt_tokens") + longer <= max_length,
        }
    )


def allowed_tasks(df: DataFrame, tasks: str | None = None, column: str = "task") -> DataFrame:
    """Rows whose task is in the comma list, each name stripped; without a list, all known benchmarks."""
    names = list(ALL_TASKS) if tasks is None else [t.strip() for t in tasks.split(",")]
    return df.filter(F.col(column).isin(names))
