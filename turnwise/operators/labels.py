"""Tokenised training rows: ids, attention mask and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.operators.chat import CHATML, ChatTemplate, prompt_messages, render_messages
from turnwise.operators.tokens import Encoder, SpecialIds, with_ids

IGNORE_INDEX = -100  # fixed value: label the loss skips
MAX_SEQ_LENGTH = 4096


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def masked_labels(ids: Column, prompt_size: Column, compat: bool = False) -> Column:
    """Labels with the first ``prompt_size`` entries ignored.

    When the prompt is longer than the kept ids the labels are clipped to the ids; ``compat=True`` keeps the longer
    label list instead.
    """
    masked = prompt_size if compat else F.least(prompt_size, F.size(ids))
    rest = F.slice(ids, prompt_size + 1, F.greatest(F.size(ids) - prompt_size, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), masked), rest)


def full_examples(
    df: DataFrame,
    encoder: Encoder,
    max_seq_length: int = MAX_SEQ_LENGTH,
    add_special_tokens: bool = True,
    special: SpecialIds = SpecialIds(),
    template: ChatTemplate = CHATML,
    messages: str = "messages",
) -> DataFrame:
    """Render, tokenise and copy the ids to the labels; ``messages`` stays. One narrow stage, unless the ids are a join."""
    text = render_messages(F.col(messages), template)
    return with_ids(df, text, encoder, max_seq_length, add_special_tokens, special).select(
        *df.columns, "input_ids", attention_mask(F.col("input_ids")).alias("attention_mask"), F.col("input_ids").alias("labels")
    )


def completion_examples(
    df: DataFrame,
    encoder: Encoder,
    max_seq_length: int = MAX_SEQ_LENGTH,
    special: SpecialIds = SpecialIds(),
    template: ChatTemplate = CHATML,
    messages: str = "messages",
    compat: bool = False,
) -> DataFrame:
    """Like :func:`full_examples`, with the part up to the first answer ignored in the labels.

    Later user turns are not ignored. The prompt is measured without marker ids, the full text has them.
    """
    prompt = render_messages(prompt_messages(F.col(messages)), template, add_generation_prompt=True)
    text = render_messages(F.col(messages), template)
    kept = df.columns
    return (
        with_ids(df, text, encoder, max_seq_length, True, special)
        .withColumn("prompt_size", encoder.count(prompt))
        .withColumns(
            {
                "attention_mask": attention_mask(F.col("input_ids")),
                "labels": masked_labels(F.col("input_ids"), F.col("prompt_size"), compat),
            }
        )
        .select(*kept, "input_ids", "attention_mask", "labels")
    )
