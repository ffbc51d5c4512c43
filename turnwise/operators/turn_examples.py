"""Training rows straight from a turn table, without gathering whole conversations.

A training row is the first ``max_seq_length`` ids of the rendered conversation. Every turn renders to at least one id,
so no more than that many leading turns can matter; everything after the cut to those turns works on groups of that
size. The ids of a conversation must be as many as those of its turns together: true for bytes, for the pattern tokens (a
ChatML turn ends in a blank and the next begins with a marker), and for a tokenizer that has the markers as special tokens.
That is tried on turns with difficult borders when the plan is made; an encoder and template that fail are refused.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnwise.operators.chat import CHATML, ChatTemplate, render_turn
from turnwise.operators.hot import hot_join
from turnwise.operators.labels import MAX_SEQ_LENGTH, attention_mask, masked_labels
from turnwise.operators.tokens import Encoder, SpecialIds, TableEncoder, with_ids
from turnwise.operators.turns import MAX_LARGE

LARGE = 100_000  # turns of one conversation that a single task may sort
SLICES = 256


def leading_turns(
    turns: DataFrame, n: int, conv: str, order: list[str], large: int = LARGE, slices: int = SLICES
) -> DataFrame:
    """The first ``n`` turns of each conversation, with their ``place``.

    A count over the key column looks for conversations of more than ``large`` turns. If there are any, their turns are
    first cut to ``n`` in each of ``slices`` slices, so that no task sorts a whole one; all others take the short way.
    """
    hot = turns.groupBy(conv).count().filter(F.col("count") > large).select(conv)
    n_hot = hot.limit(MAX_LARGE + 1).count()
    if n_hot > MAX_LARGE:  # too many to send to every task: slice them all
        turns = _sliced(turns, n, conv, order, slices)
    elif n_hot > 0:
        few = F.broadcast(hot)
        cut = _sliced(turns.join(few, conv, "left_semi"), n, conv, order, slices)
        turns = turns.join(few, conv, "left_anti").unionByName(cut)
    place = F.row_number().over(Window.partitionBy(conv).orderBy(*order))
    return turns.withColumn("place", place).filter(F.col("place") <= n)


def _sliced(turns: DataFrame, n: int, conv: str, order: list[str], slices: int) -> DataFrame:
    """The first ``n`` turns of each slice of a conversation; the first ``n`` of all are among them."""
    piece = F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(slices))
    in_slice = F.row_number().over(Window.partitionBy(conv, "slice").orderBy(*order))
    ranked = turns.withColumn("slice", piece).withColumn("place", in_slice)
    return ranked.filter(F.col("place") <= n).drop("slice", "place")


BORDERS = ("", "a", "1", " ", "\n", "é", ".", "a b", "<", "'s")  # contents whose ends could join with what follows


def require_additive(spark: SparkSession, encoder: Encoder, template: ChatTemplate) -> None:
    """Refuses an encoder whose ids of two turns together are not as many as those of each."""
    pairs = spark.createDataFrame([(a, b) for a in BORDERS for b in BORDERS], "a string, b string")
    one, two = (render_turn(F.lit(r), F.col(c), template) for r, c in (("user", "a"), ("assistant", "b")))
    header = F.lit(template.generation_header)
    whole = encoder.count(F.concat(one, two)) == encoder.count(one) + encoder.count(two)
    opened = encoder.count(F.concat(one, header)) == encoder.count(one) + encoder.count(header)
    if pairs.select((whole & opened).alias("same")).filter(~F.col("same")).count():
        raise ValueError("with this template the encoder's ids of a conversation are not those of its turns together")


def prompt_sizes(turns: DataFrame, encoder: Encoder, template: ChatTemplate, conv: str, order: list[str], role: str, content: str) -> DataFrame:
    """``(conv, whole_prompt)``: ids of all the turns before the first answer, or of all if there is none.

    Sums over each conversation; first answers meet the turns by a join that deals a large conversation over tasks.
    """
    key = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    sized = turns.select(conv, key.alias("key"), role, encoder.count(render_turn(F.col(role), F.col(content), template)).alias("n"))
    firsts = sized.filter(F.col(role) == "assistant").groupBy(conv).agg(F.min("key").alias("first"))
    met = hot_join(sized.select(conv, "key", "n"), firsts, [conv], "left", null_safe=True)
    before = F.when(F.col("first").isNull() | (F.col("key") < F.col("first")), F.col("n")).otherwise(0)
    return met.groupBy(conv).agg(F.sum(before).alias("whole_prompt"))


def examples_from_turns(
    turns: DataFrame,
    encoder: Encoder,
    max_seq_length: int = MAX_SEQ_LENGTH,
    template: ChatTemplate = CHATML,
    completion_only: bool = True,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    large: int = LARGE,
    special: SpecialIds = SpecialIds(),
    compat: bool = False,
) -> DataFrame:
    """``(conv, input_ids, attention_mask, labels)``: the same rows as rendering and encoding whole conversations.

    Turns with the same number are taken in the order of their role and text. With ``completion_only`` the labels up
    to the first answer are ignored, otherwise they are the ids. ``compat`` keeps a label list that is longer than the ids
    where the prompt is: one number per conversation says how long it is, however much of it was cut off. With a vocabulary
    table the conversations need a key each, as the ids meet them by it.
    """
    if isinstance(encoder, TableEncoder):
        encoder = replace(encoder, row_id=conv)
    require_additive(turns.sparkSession, encoder, template)
    earlier = Window.partitionBy(conv).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rendered = render_turn(F.col(role), F.col(content), template)
    pieces = (
        leading_turns(turns, max_seq_length, conv, [turn, role, content], large)
        .select(conv, "place", role, rendered.alias("piece"))
        .withColumn("n", encoder.count(F.col("piece")))
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("bigint"))
        .filter(F.col("start") < max_seq_length)
    )
    answer = F.min(F.when(F.col(role) == "assistant", F.col("start")))
    # still partitioned by conversation, so gathering the kept text moves nothing; ids are made from it afterwards
    gathered = pieces.groupBy(conv).agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"), answer.alias("answer")
    )
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    examples = with_ids(gathered, text, encoder, max_seq_length, True, special)
    labels = F.col("input_ids")
    if completion_only:
        # without an answer among the kept ids, the prompt covers them all
        header = encoder.count(F.lit(template.generation_header))
        prompt = F.coalesce(F.col("answer"), F.lit(max_seq_length)) + header
        if compat:
            sizes = prompt_sizes(turns, encoder, template, conv, [turn, role, content], role, content)
            sizes = sizes.withColumnRenamed(conv, "of")
            examples = examples.join(sizes, F.col(conv).eqNullSafe(F.col("of"))).drop("of")
            prompt = F.col("whole_prompt") + header
        examples = examples.withColumn("prompt_size", prompt.cast("int"))
        labels = masked_labels(F.col("input_ids"), F.col("prompt_size"), compat)
    return examples.withColumn("attention_mask", attention_mask(F.col("input_ids"))).select(
        conv, "input_ids", "attention_mask", labels.alias("labels")
    )
