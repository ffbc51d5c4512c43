"""Corpus layouts to the two shapes everything else works on: message lists and preference triples.

All of these are narrow projections: no shuffle, and only the named columns reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import present
from turnwise.sources.registry import CorpusSpec

ROW_ID = "row_id"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def column_or(df: DataFrame, name: str, default: str = "") -> Column:
    """The column, or a constant when the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(default)


def _kept(df: DataFrame) -> list[str]:
    return [ROW_ID] if ROW_ID in df.columns else []


def alpaca_messages(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """``instruction`` (+ blank line + ``input`` when present) as user, ``output`` as assistant."""
    instruction, output = F.col(spec.column("instruction")), F.col(spec.column("output"))
    extra = column_or(df, spec.column("input"))
    asked = F.when(present(extra), F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)
    return df.select(*_kept(df), F.array(message("user", asked), message("assistant", output)).alias("messages"))


def sharegpt_messages(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Turn lists: ``human`` becomes user, every other sender becomes assistant; order kept."""

    def turn(t: Column) -> Column:
        return message(F.when(t["from"] == "human", F.lit("user")).otherwise(F.lit("assistant")), t["value"])

    return df.select(*_kept(df), F.transform(F.col(spec.column("conversation")), turn).alias("messages"))


def openorca_messages(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """System message when present, then question and response."""
    system = column_or(df, spec.column("system"))
    asked = message("user", F.col(spec.column("question")))
    answered = message("assistant", F.col(spec.column("response")))
    return df.select(
        *_kept(df),
        F.when(present(system), F.array(message("system", system), asked, answered))
        .otherwise(F.array(asked, answered))
        .alias("messages"),
    )


def ultrafeedback_triples(df: DataFrame, spec: CorpusSpec, strict: bool = True) -> DataFrame:
    """Prompt with the last chosen and the last rejected message.

    An empty message list is an error; with ``strict=False`` it gives NULL, for the quarantine.
    """

    def last(role: str) -> Column:
        messages = F.col(spec.column(role))
        content = F.try_element_at(messages, F.lit(-1))["content"]
        if strict:
            empty = F.raise_error(F.lit(f"a row without {role} messages")).cast("string")
            content = F.when(F.size(messages) > 0, content).otherwise(empty)
        return content.alias(role)

    return df.select(*_kept(df), F.col(spec.column("prompt")).alias("prompt"), last("chosen"), last("rejected"))


def transcript_triples(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Whole transcripts on both sides and an empty prompt."""
    return df.select(
        *_kept(df),
        F.lit("").alias("prompt"),
        F.col(spec.column("chosen")).alias("chosen"),
        F.col(spec.column("rejected")).alias("rejected"),
    )


ANSWER = "\n\nAssistant:"  # fixed value: what stands before an answer in a transcript


def recovered_triples(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Prompt, chosen and rejected from transcripts that are the same up to their last answer.

    Each transcript is cut after its last answer marker. ``recovered`` tells whether both have one and the heads are
    equal; where they are not, the prompt is empty and the transcripts stay whole, so that nothing is lost.
    """
    sides = {}
    for side in ("chosen", "rejected"):
        whole = F.col(spec.column(side))
        tail = F.substring_index(whole, ANSWER, -1)
        sides[side] = whole, tail, F.left(whole, F.length(whole) - F.length(tail))
    heads = [head for _, _, head in sides.values()]
    marked = F.endswith(heads[0], F.lit(ANSWER)) & (heads[0] == heads[1])
    same = F.coalesce(marked, F.lit(False))
    return df.select(
        *_kept(df),
        F.when(same, heads[0]).otherwise(F.lit("")).alias("prompt"),
        *[F.when(same, tail).otherwise(whole).alias(side) for side, (whole, tail, _) in sides.items()],
        same.alias("recovered"),
    )


def unchanged(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Registered corpora without a layout of their own pass through; the result is not a triple."""
    return df


FORMATS: dict[str, Callable[[DataFrame, CorpusSpec], DataFrame]] = {
    "alpaca": alpaca_messages,
    "sharegpt": sharegpt_messages,
    "openorca": openorca_messages,
    "ultrafeedback": ultrafeedback_triples,
    "anthropic_hh": transcript_triples,
    "helpsteer": unchanged,
}

# Roles that must be there for a row to be usable; optional ones (input, system) are left out.
REQUIRED_ROLES: dict[str, Sequence[str]] = {
    "alpaca": ("instruction", "output"),
    "sharegpt": ("conversation",),
    "openorca": ("question", "response"),
    "ultrafeedback": ("prompt", "chosen", "rejected"),
    "anthropic_hh": ("chosen", "rejected"),
    "helpsteer": (),
}


def format_corpus(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Dispatch on the corpus name. Source columns are dropped, ``row_id`` is kept."""
    return FORMATS[spec.name](df, spec)


def _complete(spec: CorpusSpec) -> Column:
    ok = F.lit(True)
    for role in REQUIRED_ROLES[spec.name]:
        ok = ok & F.col(spec.column(role)).isNotNull()
    if spec.name == "sharegpt":
        ok = ok & ~F.exists(F.col(spec.column("conversation")), lambda t: t["value"].isNull())
    if spec.name == "ultrafeedback":
        for role in ("chosen", "rejected"):
            ok = ok & F.exists(F.slice(F.col(spec.column(role)), -1, 1), lambda m: m["content"].isNotNull())
    return ok


def required_rows(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """All rows; the first one that lacks a required field is an error when it is read."""
    checked = F.assert_true(F.coalesce(_complete(spec), F.lit(False)), F.lit(f"a {spec.name} row lacks a required field"))
    return df.filter(checked.isNull())


def usable_rows(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Rows whose required fields are all there, down to the text of each message that is used."""
    return df.filter(_complete(spec))


def quarantined_rows(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """The complement of :func:`usable_rows`: nothing is lost between the two."""
    return df.filter(~F.coalesce(_complete(spec), F.lit(False)))
