"""Finding and reading a corpus folder in whichever layout it was stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from turnwise.sources import files
from turnwise.sources.json_array import read_json_array
from turnwise.sources.registry import INSTRUCTION_SPLITS, PREFERENCE_SPLITS, CorpusSpec
from turnwise.sources.saved import choose_split, load_saved


class Layout(Enum):
    SPLITS = "dataset_dict.json"
    SAVED = "dataset_info.json"
    TRAIN_FOLDER = "train"
    STATE = "state.json"
    JSON_ARRAY = "alpaca_data.json"
    PARQUET = "*.parquet"
    OTHER = ""


def detect_layout(spark: SparkSession, path: str) -> Layout:
    """The first marker that is present, in the order of :class:`Layout`."""
    names = [f.name for f in files.children(spark, path)]
    for layout in (Layout.SPLITS, Layout.SAVED, Layout.TRAIN_FOLDER, Layout.STATE, Layout.JSON_ARRAY):
        if layout.value in names:
            return layout
    if any(n.endswith(".parquet") or n.startswith("split=") for n in names):
        return Layout.PARQUET
    return Layout.OTHER


def resolve_source(spark: SparkSession, spec: CorpusSpec, roots: Sequence[str]) -> str:
    """The first ``root/name`` that exists."""
    candidates = [f"{r.rstrip('/')}/{spec.name}" for r in roots]
    for path in candidates:
        if files.exists(spark, path):
            return path
    raise FileNotFoundError(f"{spec.name} ({spec.path}, split {spec.split}) is in none of {candidates}")


def _read_parquet(spark: SparkSession, path: str, preferred: Sequence[str]) -> DataFrame:
    """Parquet rows of the preferred split. Rows without an id get their place: file name and row number."""
    df = spark.read.parquet(path)
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index"))
    if "split" not in df.columns:
        return df
    folders = [f.name.removeprefix("split=") for f in files.children(spark, path) if f.name.startswith("split=")]
    return df.filter(F.col("split") == choose_split(folders, preferred)).drop("split") if folders else df


def read_corpus_folder(spark: SparkSession, path: str, spec: CorpusSpec, preferred: Sequence[str]) -> DataFrame:
    layout = detect_layout(spark, path)
    if layout is Layout.JSON_ARRAY:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns.values()])
        return read_json_array(spark, f"{path}/{layout.value}", schema)
    if layout is Layout.PARQUET:
        return _read_parquet(spark, path, preferred)
    return load_saved(spark, path, preferred, list(spec.columns.values()) or None)  # of the shards only what plays a role


def read_instruction_corpus(spark: SparkSession, spec: CorpusSpec, roots: Sequence[str]) -> DataFrame:
    return read_corpus_folder(spark, resolve_source(spark, spec, roots), spec, INSTRUCTION_SPLITS)


def read_preference_corpus(spark: SparkSession, spec: CorpusSpec, roots: Sequence[str]) -> DataFrame:
    return read_corpus_folder(spark, resolve_source(spark, spec, roots), spec, PREFERENCE_SPLITS)


def read_first_available(
    readers: Sequence[tuple[str, Callable[[], DataFrame]]], required: Sequence[str] = ()
) -> tuple[str, DataFrame]:
    """Tries the readers in order and returns the name of the first that works, with its table.

    A reader works when it resolves a schema holding the required columns; no job is run to find out.
    """
    problems = []
    for name, reader in readers:
        try:
            df = reader()
            lacking = [c for c in required if c not in df.columns]
        except Exception as e:  # any failure moves on to the next source
            problems.append(f"{name}: {e}")
            continue
        if not lacking:
            return name, df
        problems.append(f"{name}: lacks {lacking}")
    raise ValueError("no source could be read: " + "; ".join(problems))
