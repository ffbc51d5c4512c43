"""Conversations stored one row per turn, keyed by ``(conversation, turn)``.

A single conversation may hold a large share of all rows. Rendering is per turn and totals are partial aggregates. A
message list is one row as long as the conversation fits one (``ROW_BYTES``); a larger conversation, or one of more
messages than the caller allows, comes in *parts* of messages that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.operators.chat import CHATML, ChatTemplate, render_turn
from turnwise.operators.formats import message
from turnwise.operators.hot import hot_join

PART = 1024  # messages of a part of a conversation that does not fit a row
ROW_BYTES = 64 << 20  # of text, with MESSAGE_BYTES for each message
MESSAGE_BYTES = 64
MAX_LARGE = 1 << 20  # conversations a broadcast may list, about 32 MB


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _placed(large: DataFrame, size: int) -> DataFrame:
    """Rows of large conversations with ``place``, their position from 0, and ``copies``, how many equal rows they stand for.

    The range of a conversation's turn numbers is cut into about as many steps as it has parts. Rows before a step are
    sums over steps, and places in a step are sums over its distinct rows, so no task sees a whole conversation unless
    nearly all of its turns share a few numbers; equal rows are counted before, and only counted.
    """
    bounds = large.groupBy("conv").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.ceil(F.count(F.lit(1)) / size).alias("steps")
    )
    rows = large.groupBy("conv", "turn", "role", "content").agg(F.count(F.lit(1)).alias("copies"))
    width = F.greatest((F.col("high").cast("double") - F.col("low") + 1) / F.col("steps"), F.lit(1.0))
    step = F.coalesce(F.floor((F.col("turn").cast("double") - F.col("low")) / width), F.lit(-1))  # turns without a number first
    found = bounds.withColumnRenamed("conv", "of")
    rows = rows.join(found, _same(F.col("conv"), F.col("of")), "left").withColumn("step", step).drop("of", "low", "high", "steps")
    totals = rows.groupBy("conv", "step").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv").alias("of"), F.col("step").alias("of_step"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conv", "step").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rows = rows.join(totals, _same(F.col("conv"), F.col("of")) & (F.col("step") == F.col("of_step")))
    return rows.withColumn("place", F.col("before") + F.col("inside")).drop("of", "of_step", "before", "inside", "step")


def messages_from_turns(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    part_size: int | None = None,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """``(conv, part, n_parts, messages)``: the messages of a conversation in the order of turn, role and text.

    A conversation is one row if its messages take up to ``row_bytes``. A larger one, and with a ``part_size`` every one
    of more messages, comes in ``n_parts`` rows of at most ``part_size`` (or ``PART``) messages. Parts are cut by the
    position of the message and never by its turn number, so they do not depend on numbering, partitions or repeated
    turns. Turns without a number come first; turns without a conversation are one of their own.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    weight = F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + MESSAGE_BYTES)
    too_large = weight > row_bytes if part_size is None else (weight > row_bytes) | (F.count(F.lit(1)) > part_size)
    part_size = part_size or PART
    large = rows.groupBy("conv").agg(too_large.alias("large")).filter("large").select(F.col("conv").alias("of"))
    n_large = large.limit(MAX_LARGE + 1).count()
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))

    def lists(grouped: Column) -> Column:
        return F.transform(grouped, lambda t: message(t["role"], t["content"])).alias("messages")

    whole = rows if n_large == 0 else rows.join(
        F.broadcast(large) if n_large <= MAX_LARGE else large, _same(F.col("conv"), F.col("of")), "left_anti"
    )
    out = whole.groupBy("conv").agg(ordered.alias("ordered")).select(
        F.col("conv").alias(conv), F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_parts"), lists(F.col("ordered"))
    )
    if n_large == 0:
        return out
    kept = rows.join(F.broadcast(large) if n_large <= MAX_LARGE else large, _same(F.col("conv"), F.col("of")), "left_semi")
    sizes = kept.groupBy("conv").agg(F.ceil(F.count(F.lit(1)) / part_size).alias("n_parts")).withColumnRenamed("conv", "of")
    # copies that span parts are dealt to each of them by count, and only then written out one by one
    last = F.col("place") + F.col("copies") - 1
    pieces = _placed(kept, part_size).withColumn("part", F.explode(F.sequence(
        F.call_function("div", F.col("place"), F.lit(part_size)), F.call_function("div", last, F.lit(part_size))
    )))
    first_here = F.greatest(F.col("place"), F.col("part") * part_size)
    last_here = F.least(last, (F.col("part") + 1) * part_size - 1)
    pieces = pieces.withColumn("times", (last_here - first_here + 1).cast("int"))
    gathered = F.sort_array(F.collect_list(F.struct("turn", "role", "content", "times")))
    repeated = F.flatten(F.transform(F.col("ordered"), lambda t: F.array_repeat(F.struct(t["role"].alias("role"), t["content"].alias("content")), t["times"])))
    parts = pieces.groupBy("conv", "part").agg(gathered.alias("ordered")).join(sizes, _same(F.col("conv"), F.col("of")))
    return out.unionByName(parts.select(F.col("conv").alias(conv), F.col("part").cast("bigint").alias("part"), "n_parts", lists(repeated)))


def exchanges(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """``(conv, turn, asked, answered, system)``: each user turn that the next turn number answers.

    Turns meet by ``(conv, turn)``, so a large conversation is many join keys. ``system`` is the conversation's first
    system text, empty if it has none. Turns without a number or a conversation answer nothing.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    asked = rows.filter("role = 'user'").select("conv", "turn", F.col("content").alias("asked"))
    answered = rows.filter("role = 'assistant'").select("conv", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answered"))
    system = rows.filter("role = 'system'").groupBy("conv").agg(F.min(F.struct("turn", "content"))["content"].alias("system"))
    # a large conversation is dealt over several tasks
    return (
        hot_join(asked.join(answered, ["conv", "turn"]), system, ["conv"], "left")
        .select(F.col("conv").alias(conv), F.col("turn").alias(turn), "asked", "answered", F.coalesce("system", F.lit("")).alias("system"))
    )


def rendered_turns(
    turns: DataFrame, template: ChatTemplate = CHATML, role: str = "role", content: str = "text"
) -> DataFrame:
    """Each turn's piece of the rendered conversation. Joined in turn order the pieces are the chat text."""
    return turns.withColumn("rendered", render_turn(F.col(role), F.col(content), template))


def prompt_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Turns before the first assistant turn; every turn of a conversation that has none.

    Answers are left where they are: only their first turn numbers, a partial aggregate, meet the other turns. Large
    conversations are found by a count and dealt over several tasks. A turn without a number stays
    if nothing in its conversation is an answer with a number; turns without a conversation are one of their own.
    """
    answer = F.coalesce(F.col(role) == "assistant", F.lit(False))
    firsts = turns.filter(answer).groupBy(conv).agg(F.min(turn).alias("first_answer"))
    joined = hot_join(turns.filter(~answer), firsts, [conv], "left", null_safe=True)
    return joined.filter(F.col("first_answer").isNull() | (F.col(turn) < F.col("first_answer"))).drop("first_answer")


def first_answered(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
) -> DataFrame:
    """One row per conversation: first user and system text, first and last assistant text, answer count.

    Each is a minimum or maximum over ``(turn, text)``, which keeps one text per group and does not depend on row
    order; map tasks send one row per conversation they saw.
    """

    def pick(extreme, who: str) -> Column:
        placed = F.struct(F.col(turn).alias("turn"), F.col(content).alias("text"))
        return extreme(F.when(F.col(role) == who, placed))["text"]

    return turns.groupBy(conv).agg(
        pick(F.min, "user").alias("asked"),
        F.coalesce(pick(F.min, "system"), F.lit("")).alias("system"),
        pick(F.min, "assistant").alias("answered"),
        pick(F.max, "assistant").alias("answered_last"),
        F.count_if(F.col(role) == "assistant").alias("n_answers"),
    )
