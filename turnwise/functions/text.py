"""String, regex and prompt-text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- fixed values: patterns recorded in the benchmark configuration -------------------------
STRICT_ANSWER = r"#### (\-?[0-9\.\,]+)"
FLEXIBLE_ANSWER = r"(-?[$0-9.,]{2,})|(-?[0-9]+)"
IGNORED_IN_ANSWERS = (",", r"\$", r"(?s).*#### ", r"\.$")
BLANK = r"[\s\x1c-\x1f]"
STOP_STRINGS = ("Question:", "</s>", "<|im_end|>")
# ---------------------------------------------------------------------------------------------


def present(c: Column) -> Column:
    """Neither NULL nor empty. Whitespace counts as present."""
    return F.coalesce(c, F.lit("")) != ""


def strip(c: Column) -> Column:
    """Remove all leading and trailing Unicode whitespace (``trim`` removes only spaces)."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)^{BLANK}+", ""), rf"(?U){BLANK}+\z", "")


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def title_label(c: Column) -> Column:
    """``arc_challenge`` -> ``Arc Challenge``; every run of letters is capitalised, also after a digit."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def wrapped_label(c: Column) -> Column:
    """``arc_challenge`` on two lines, for axis labels."""
    return F.replace(c, F.lit("_"), F.lit("\n"))


def cut(c: Column, width: int) -> Column:
    """The first ``width`` characters; the ellipsis is always appended."""
    return F.concat(F.substring(c, 1, width), F.lit("..."))


def comma_list(c: Column) -> Column:
    """Split on commas and strip each part."""
    return F.transform(F.split(c, ","), strip)


def fixed(c: Column, digits: int) -> Column:
    """A number with that many decimals, rounded half-even on its exact binary value.

    ``format_string`` would round half up on the shortest decimal form instead and turn 0.125 into 0.13.
    """
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits))


def signed_points(diff: Column) -> Column:
    """``+1.5%`` when positive, ``-1.5%`` or ``0.0%`` otherwise, NULL stays NULL."""
    shown = F.concat(fixed(diff, 1), F.lit("%"))
    return F.when(diff > 0, F.concat(F.lit("+"), shown)).otherwise(shown)


def percent_or_na(value: Column) -> Column:
    """Fraction as a percentage with two decimals; a missing or zero value shows as N/A."""
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, fixed(value * 100, 2)).otherwise(F.lit("N/A"))


def gain_text(points: Column) -> Column:
    """Gain with two decimals and a sign that is always written."""
    shown = F.concat(fixed(points, 2), F.lit("%"))
    return F.when(shown.startswith("-"), shown).otherwise(F.concat(F.lit("+"), shown))


def run_name(name: Column, ts: Column) -> Column:
    """``model_20250131_235959``."""
    return F.concat(name, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def run_timestamp(ts: Column) -> Column:
    """``2025-01-31 23:59:59``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_timestamp(ts: Column) -> Column:
    """``2025-01-31T23:59:59.123456``, without the fraction when it is zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


# --- answers ---------------------------------------------------------------------------------


def strict_answer(response: Column) -> Column:
    """First number after ``#### ``; NULL when there is none."""
    got = F.regexp_extract(response, STRICT_ANSWER, 1)
    return F.when(got != "", got)


def flexible_answer(response: Column) -> Column:
    """Last number-like run in the text; NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(response, F.lit(FLEXIBLE_ANSWER), F.lit(0)), F.lit(-1))


def normalise_answer(c: Column, ignored: Sequence[str] = IGNORED_IN_ANSWERS) -> Column:
    """Drop the ignored patterns in order, then lower-case."""
    for pattern in ignored:
        c = F.regexp_replace(c, pattern, "")
    return F.lower(c)


def until_stop(generation: Column, stops: Sequence[str] = STOP_STRINGS) -> Column:
    """Text before the earliest stop string."""
    either = "|".join("\\Q" + s + "\\E" for s in stops)
    return F.split(generation, either, 2)[0]


# --- prompts ---------------------------------------------------------------------------------


def question_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def lettered_prompt(question: Column, choices: Column) -> Column:
    """Stripped question, one ``A. text`` line per choice, then ``Answer:``."""
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + F.lit(65)), F.lit(". "), c))
    return F.concat(F.lit("Question: "), strip(question), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def gold_index(labels: Column, key: Column) -> Column:
    """Zero-based position of the answer key, NULL when the key is not among the labels."""
    at = F.array_position(labels, key)
    return F.when(at > 0, at - 1)


def activity_query(activity: Column, ctx_a: Column, ctx_b: Column) -> Column:
    return F.concat(activity, F.lit(": "), ctx_a, F.lit(" "), capitalize(ctx_b))


def blank_contexts(sentence: Column, options: Column) -> Column:
    """The text left of the first ``_`` with each option appended; NULL when there is no blank."""
    at = F.instr(sentence, "_")
    left = F.substring(sentence, F.lit(1), at - 1)
    return F.when(at > 0, F.transform(options, lambda o: F.concat(left, o)))


def blank_continuation(sentence: Column) -> Column:
    """The stripped text right of the first ``_``; NULL when there is no blank."""
    at = F.instr(sentence, "_")
    return F.when(at > 0, strip(F.substring(sentence, at + 1, F.length(sentence))))


def blank_gold(answer: Column) -> Column:
    """Answer ``1`` or ``2`` as a zero-based index."""
    return F.when(answer == "1", F.lit(0)).when(answer == "2", F.lit(1))


def with_target(example: Column, target: Column, delimiter: str = " ") -> Column:
    return F.concat_ws(delimiter, example, target)


def joined_shots(shots: Column, delimiter: str = "\n\n") -> Column:
    return F.array_join(shots, delimiter)
