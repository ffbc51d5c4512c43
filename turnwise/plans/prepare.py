"""Preparing a corpus: read, format, tokenise, filter, split, write, describe."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.operators.chat import CHATML, ChatTemplate, render_messages
from turnwise.operators.filters import within_length
from turnwise.operators.formats import format_corpus, quarantined_rows, required_rows, usable_rows
from turnwise.operators.labels import MAX_SEQ_LENGTH, full_examples
from turnwise.operators.splits import exact_split, preference_split
from turnwise.operators.stats import length_stats
from turnwise.operators.tokens import Encoder, SpecialIds
from turnwise.sources import files
from turnwise.sources.corpora import (
    Layout, detect_layout, read_instruction_corpus, read_preference_corpus, resolve_source,
)
from turnwise.sources.registry import PREFERENCE_CORPORA, CorpusSpec, instruction_spec, preference_spec

DATA_ROOT = "data/raw"
OPTIONS = "_options"  # file in a prepared table, which Spark does not read
MAX_OPTIONS = 1 << 20


@dataclass(frozen=True)
class PrepareOptions:
    """``on_overflow``: ``truncate`` cuts long rows (and then drops none), ``drop`` removes them."""

    max_seq_length: int = MAX_SEQ_LENGTH
    validation_size: float = 0.02
    seed: int = 42
    on_overflow: str = "truncate"
    special: SpecialIds = field(default_factory=SpecialIds)
    template: ChatTemplate = CHATML

    def __post_init__(self):
        if self.on_overflow not in ("truncate", "drop"):
            raise ValueError(f"on_overflow must be truncate or drop, not {self.on_overflow}")


def tokenised_rows(raw: DataFrame, spec: CorpusSpec, encoder: Encoder, options: PrepareOptions) -> DataFrame:
    """Formatted and tokenised rows: one narrow stage. Cut rows need no length filter, it would keep them all."""
    messages = format_corpus(usable_rows(raw, spec), spec)
    if options.on_overflow == "truncate":
        return full_examples(
            messages, encoder, options.max_seq_length, special=options.special, template=options.template
        )
    rows = full_examples(messages, encoder, None, special=options.special, template=options.template)
    return within_length(rows, options.max_seq_length)


def with_split(rows: DataFrame, options: PrepareOptions, keys: DataFrame | None = None) -> DataFrame:
    """Train and validation. To find the boundary, the keys of the rows are read twice, from ``keys`` if given."""
    return exact_split(rows, "row_id", options.validation_size, options.seed, keys=keys)


def load_instruction_corpus(
    spark: SparkSession,
    name: str,
    encoder: Encoder,
    options: PrepareOptions = PrepareOptions(),
    roots: Sequence[str] = (DATA_ROOT,),
) -> DataFrame:
    """An unknown name is refused before anything is read."""
    spec = instruction_spec(name)
    return with_split(tokenised_rows(read_instruction_corpus(spark, spec, roots), spec, encoder, options), options)


def load_preference_corpus(
    spark: SparkSession, name: str, roots: Sequence[str] = (DATA_ROOT,), strict: bool = True
) -> DataFrame:
    """Triples (or the unchanged rows of a corpus without a layout). No tokenising happens here.

    A row without a required field is an error; with ``strict=False`` it is left out, and ``rejected_rows`` has it.
    """
    spec = preference_spec(name)
    raw = read_preference_corpus(spark, spec, roots)
    return format_corpus(required_rows(raw, spec) if strict else usable_rows(raw, spec), spec)


def _raw_rows(spark: SparkSession, name: str, roots: Sequence[str]) -> tuple[DataFrame, CorpusSpec]:
    if name in PREFERENCE_CORPORA:
        spec = preference_spec(name)
        return read_preference_corpus(spark, spec, roots), spec
    spec = instruction_spec(name)
    return read_instruction_corpus(spark, spec, roots), spec


def rejected_rows(spark: SparkSession, name: str, roots: Sequence[str] = (DATA_ROOT,)) -> DataFrame:
    """Raw rows of a corpus of either kind that preparing leaves out because a required field is missing."""
    return quarantined_rows(*_raw_rows(spark, name, roots))


def losses(
    spark: SparkSession,
    name: str,
    encoder: Encoder | None = None,
    options: PrepareOptions = PrepareOptions(),
    roots: Sequence[str] = (DATA_ROOT,),
) -> DataFrame:
    """``(n_rows, n_rejected, n_overlong)`` of a corpus: what preparing reads, and what it leaves out for either reason.

    Rows are overlong if their whole text has more ids than the limit: these are cut, or dropped with ``drop``.
    """
    raw, spec = _raw_rows(spark, name, roots)
    rejected = quarantined_rows(raw, spec).agg(F.count(F.lit(1)).alias("n_rejected"))
    total = raw.agg(F.count(F.lit(1)).alias("n_rows"))
    overlong = F.lit(0).cast("bigint")
    if encoder is not None and name not in PREFERENCE_CORPORA:
        text = render_messages(F.col("messages"), options.template)
        long = format_corpus(usable_rows(raw, spec), spec).filter(encoder.count(text) > options.max_seq_length)
        overlong = long.agg(F.count(F.lit(1))).scalar()
    return total.select("n_rows", rejected.scalar().alias("n_rejected"), overlong.alias("n_overlong"))


def prepared_path(out: str, name: str, kind: str) -> str:
    """``{out}/{name}_sft`` or ``{out}/{name}_preference``."""
    return f"{out.rstrip('/')}/{name}_{kind}"


def write_prepared(
    df: DataFrame, path: str, skip_existing: bool = False, even_files: bool = False, replace: bool = False
) -> None:
    """Parquet, one folder per split when there is one. ``skip_existing`` leaves an existing target alone, ``replace``
    writes it anew; otherwise it is an error.

    By default each task writes what it holds, without a shuffle, which makes as many small validation files as there
    are tasks. ``even_files`` pays one adaptive shuffle for files of the advisory partition size in both folders; the
    large split is cut into as many partitions as it needs.
    """
    parts = ["split"] if "split" in df.columns else []
    if even_files:
        df = df.hint("rebalance", *parts)
    writer = df.write.mode("ignore" if skip_existing else "overwrite" if replace else "errorifexists")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)


def read_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], options: str | None = None
) -> DataFrame:
    """The prepared table if it is there, complete and made with the same options, otherwise built, written and read back.

    A table is built in a folder of its own, with its ``options`` in it, and takes the place of the old one when it is
    complete: until then, and after a build that fails, the old table is there and readable.
    """
    files.restore_folder(spark, path)
    if files.exists(spark, path):
        if not files.exists(spark, f"{path}/_SUCCESS"):
            raise ValueError(f"{path} exists but was not written to the end; remove it to build it again")
        if options is None:
            return spark.read.parquet(path)
        noted = f"{path}/{OPTIONS}"
        if files.exists(spark, noted) and files.read_head(spark, noted, MAX_OPTIONS).decode("utf-8") == options:
            return spark.read.parquet(path)
    building = f"{path}_building-{uuid.uuid4().hex}"
    try:
        write_prepared(build(), building)
        if options is not None:
            files.write_text(spark, f"{building}/{OPTIONS}", options)
        files.replace_folder(spark, building, path)
    finally:
        files.remove(spark, building)  # what a failure left
    return spark.read.parquet(path)


def staged(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """The same rows read back from an intermediate table, which is written anew each time."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepare_instruction_corpus(
    spark: SparkSession,
    name: str,
    encoder: Encoder,
    out: str,
    options: PrepareOptions = PrepareOptions(),
    roots: Sequence[str] = (DATA_ROOT,),
) -> tuple[DataFrame, DataFrame]:
    """The prepared table and its statistics. Intermediate tables, where one pays off, are written next to it.

    The statistics are read from what was written, so nothing is tokenised twice, and from the attention mask: it is as
    long as the ids, but all ones, so the column takes next to no space.
    """
    spec = instruction_spec(name)
    path = prepared_path(out, name, "sft")

    def raw() -> DataFrame:
        source = read_instruction_corpus(spark, spec, roots)
        # read more than once below, which parquet makes cheap; JSON and Arrow shards do not
        if detect_layout(spark, resolve_source(spark, spec, roots)) is Layout.PARQUET:
            return source
        return staged(spark, f"{path}_source", source)

    def build() -> DataFrame:
        source = raw()
        rows = tokenised_rows(source, spec, encoder, options)
        if options.on_overflow == "truncate":
            # telling usable rows from others reads the texts: do that once, not for each step of the split
            keys = staged(spark, f"{path}_keys", usable_rows(source, spec).select("row_id"))
            return with_split(rows, options, keys)
        # which rows exist depends on their tokens: write them once
        return with_split(staged(spark, f"{path}_unsplit", rows), options)

    rows = read_or_build(spark, path, build, f"{name} {options} {encoder.identity()}")
    return rows, length_stats(rows, F.size("attention_mask"), by="split")


def prepare_preference_corpus(
    spark: SparkSession, name: str, out: str, roots: Sequence[str] = (DATA_ROOT,)
) -> tuple[DataFrame, DataFrame]:
    path = prepared_path(out, name, "preference")
    rows = read_or_build(spark, path, lambda: load_preference_corpus(spark, name, roots), name)
    return rows, rows.agg(F.count(F.lit(1)).alias("n_rows"))


def preference_training_rows(spark: SparkSession, name: str, out: str, roots: Sequence[str] = (DATA_ROOT,)) -> DataFrame:
    """Prepared preference rows with a ``split`` column: their own when they have one, else 2 percent, seed 42."""
    rows, _ = prepare_preference_corpus(spark, name, out, roots)
    return preference_split(rows, "row_id", 0.02, 42)
