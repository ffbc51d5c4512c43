"""Quality by weak supervision: rules vote or abstain, and a label model weighs their votes.

Each rule looks at one statistic of a text and votes good, bad, or abstains between two thresholds. How often each rule
is right when it votes is not given: expectation-maximisation estimates it from the agreement of the rules over all
documents, together with the share of good documents, and the posterior probability of good decides. Only counts of vote
patterns leave the executors, at most 3 to the power of the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrow_text import sliced, unused_name, word_codes

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) from `bad` on, good (1) up to `good`, and abstains (-1) between; `ascending` says which way is bad."""

    name: str
    part: str  # a statistic
    whole: str | None  # the one it is divided by, if any
    good: float
    bad: float

    def vote(self, statistics: dict[str, Column] | None = None) -> Column:
        of = statistics or {c: F.col(c) for c in STATISTICS}
        x = of[self.part] if self.whole is None else of[self.part] / F.greatest(of[self.whole], F.lit(1))
        if self.bad >= self.good:
            return F.when(x >= self.bad, 0).when(x <= self.good, 1).otherwise(-1)
        return F.when(x <= self.bad, 0).when(x >= self.good, 1).otherwise(-1)


RULES = (
    Rule("words", "n_words", None, 80, 30),
    Rule("repeated words", "n_repeat_words", "n_words", 0.3, 0.6),
    Rule("same word again", "n_same_again", "n_words", 0.05, 0.2),
    Rule("symbols", "n_symbols", "n_words", 0.05, 0.25),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.2, 0.5),
    Rule("capitals", "n_capitals", "n_letters", 0.15, 0.4),
    Rule("letters", "n_letters", "word_chars", 0.85, 0.7),
    Rule("exclamations", "n_exclaims", "n_words", 0.05, 0.3),
)

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_again", "n_lines", "n_capitals",
    "n_letters", "n_exclaims",
)


def repeated_window_words(codes: np.ndarray, starts: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text: words that lie in a window of `size` words found twice or more in it, first occurrences included."""
    n = np.diff(starts)
    texts = len(n)
    if len(codes) < size:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), n)
    begins = np.flatnonzero(owner[: len(codes) - size + 1] == owner[size - 1 :])
    if not len(begins):
        return np.zeros(texts, np.int64)
    # windows are numbered pair by pair, so that equal numbers mean equal words
    number = codes[begins].astype(np.int64)
    for k in range(1, size):
        number = np.unique(number * (int(codes.max()) + 1) + codes[begins + k], return_inverse=True)[1]
    key = owner[begins].astype(np.int64) * (int(number.max()) + 1) + number
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(codes), bool)
    for k in range(size):
        inside[begins[twice] + k] = True
    return np.bincount(owner[inside], minlength=texts)


def repeated_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line of it, and lines with a word. Lines end at \\n alone."""
    lines = pc.split_pattern(text, "\n")
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    coded = lines.flatten().dictionary_encode()
    worded = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    keep = worded[codes]
    codes, owner = codes[keep], owner[keep]
    total = np.bincount(owner, minlength=len(n))
    distinct = np.unique(owner * (len(worded) + 1) + codes)
    return total - np.bincount(distinct // (len(worded) + 1), minlength=len(n)), total


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    codes, starts, words = word_codes(text)
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)

    def total(per_word: pa.Array) -> np.ndarray:
        values = per_word.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.bincount(owner, weights=values[codes], minlength=len(n)).astype(np.int64)

    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    duplicates, lines = repeated_lines(text)
    return {
        "n_words": n,
        "word_chars": total(pc.utf8_length(words)),
        "n_symbols": total(pc.count_substring_regex(words, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_window_words(codes, starts),
        "n_same_again": np.bincount(owner[again], minlength=len(n)),
        "n_lines": lines,
        "n_capitals": total(pc.count_substring_regex(words, r"\p{Lu}")),
        "n_letters": total(pc.count_substring_regex(words, r"\p{L}")),
        "n_exclaims": total(pc.count_substring(words, "!")),
    }


def text_statistics(text: Column) -> Column:
    """The statistics of a whole text as a struct, null as empty. Words are runs of other than ASCII white space."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in STATISTICS) + ">")
    def statistics(texts: pa.Array) -> pa.Array:
        found = [measure(piece) for piece in sliced(texts, 2 << 20)]
        columns = [pa.array(np.concatenate([m[c] for m in found]) if found else [], pa.int64()) for c in STATISTICS]
        return pa.StructArray.from_arrays(columns, names=list(STATISTICS))

    return statistics(text)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per rule how often it votes right on good and on bad documents when it votes."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counted vote patterns. Starts from the majority; a weak prior keeps it from 0 and 1."""
    if not patterns:
        return LabelModel(0.5, (0.5,) * rules, (0.5,) * rules)
    votes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([c for _, c in patterns], np.float64)
    yes, no = votes == 1, votes == 0
    posterior = np.clip((yes.sum(1) + 1.0) / (yes.sum(1) + no.sum(1) + 2.0), 0.05, 0.95)
    posterior = np.where(no.sum(1) >= 1, np.minimum(posterior, 0.5), posterior)
    good, on_good, on_bad = 0.5, np.full(rules, 0.5), np.full(rules, 0.5)
    for _ in range(rounds):
        p, q = weight * posterior, weight * (1 - posterior)
        good = float((p.sum() + 2) / (weight.sum() + 3))
        on_good = (p @ yes + 9) / (p @ (yes | no) + 10)
        on_bad = (q @ no + 1) / (q @ (yes | no) + 2)
        on_good = np.maximum(on_good, 0.5)  # a rule may be useless, never the contrary of what it says
        on_bad = np.maximum(on_bad, 1 - on_good + 1e-3)
        odds = np.log(good / (1 - good)) + yes @ np.log(on_good / (1 - on_bad)) + no @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return LabelModel(good, tuple(map(float, on_good)), tuple(map(float, on_bad)))


def posterior_good(model: LabelModel, votes: list[Column]) -> Column:
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for vote, g, b in zip(votes, model.right_on_good, model.right_on_bad, strict=True):
        odds = odds + F.when(vote == 1, float(np.log(g / (1 - b)))).when(vote == 0, float(np.log((1 - g) / b))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def fit_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of all documents' votes; their counted patterns are all that leaves the executors."""
    names = [f"vote_{k}" for k in range(len(rules))]
    measured = documents.select(text_statistics(F.col("text")).alias("s")).select("s.*")
    voted = measured.select(*(r.vote().alias(n) for r, n in zip(rules, names, strict=True)))
    counted = voted.groupBy(*names).count().collect()  # at most 3 to the power of the number of rules
    return fit_votes([(tuple(r[n] for n in names), r["count"]) for r in sorted(counted)], len(rules))


def judge_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, statistics, base_failed, votes, quality, kept) per document.

    Base: under 50 words, or more than half of the words in repeated windows, fails; a document that fails is not kept,
    any other is kept if its posterior probability of being good reaches the threshold. The texts are read twice, once
    for the label model and once for the result, and never shuffled. A null text has no words. An empty table gives no
    rows.
    """
    model = fit_documents(documents, rules)
    measured = documents.select("doc_id", text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    votes = [r.vote() for r in rules]
    return measured.select(
        "*", F.expr(FAILED).alias("base_failed"), F.array(*votes).alias("votes"), posterior_good(model, votes).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The documents that `judge_documents` keeps, with all their columns."""
    model = fit_documents(documents, rules)
    found = unused_name(documents, "verdict")
    measured = documents.select("*", F.struct(text_statistics(F.col("text")).alias("s")).alias(found))
    s = {c: F.col(f"{found}.s.{c}") for c in STATISTICS}
    votes = [r.vote(s) for r in rules]
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return measured.filter(~failed & (posterior_good(model, votes) >= threshold)).drop(found)
