"""Evaluation result documents and metric files."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnwise.operators.metrics import STAGES, latest_results
from turnwise.sources import files

RESULT_FILES = "model string, modified timestamp, path string, body string"


MAX_DEPTH = 16  # levels of directories below a model's


def result_patterns(spark: SparkSession, model_dir: str) -> list[str]:
    """A pattern for each level below a directory that has a ``results*.json``, hidden-looking directories included.

    The driver asks once a level whether anything matches; the files are listed by the reader.
    """
    if not files.exists(spark, model_dir):
        warnings.warn(f"no such directory: {model_dir}", stacklevel=3)
        return []
    found, level = [], files.literal(model_dir.rstrip("/"))
    for _ in range(MAX_DEPTH):
        if files.matches(spark, f"{level}/results*.json"):
            found.append(f"{level}/results*.json")
        level += "/*"
        if not files.matches(spark, f"{level}/*"):
            break
    if not found:
        warnings.warn(f"no result files in {model_dir}", stacklevel=3)
    return found


def _document(body: Column, path: Column) -> Column:
    """The body, if it is JSON; a cut or broken file is an error that names it."""
    broken = F.raise_error(F.concat(F.lit("not a JSON document: "), path)).cast("string")
    return F.when(F.try_parse_json(body).isNotNull(), body).otherwise(broken)


def scan_results(spark: SparkSession, model_dirs: Mapping[str, str]) -> DataFrame:
    """``(model, modified, path, body)`` of all result files of all models, in one scan.

    The reader gets a pattern for each level of each model's directory; a recursive Spark scan would silently skip
    directories that begin with an underscore. A file belongs to every model whose directory leads to it.
    """
    roots = {m: files.uri(spark, folder) for m, folder in model_dirs.items()}
    wanted = []
    for m, folder in model_dirs.items():
        found = result_patterns(spark, folder)
        # a directory in another model's is scanned with that one, and one that two models have, once
        covered = any(f"{roots[m]}/".startswith(f"{r}/") for o, r in roots.items() if o != m and r != roots[m])
        wanted += [] if covered else [p for p in found if p not in wanted]
    if not wanted:
        return spark.createDataFrame([], RESULT_FILES)
    path = F.col("_metadata.file_path")
    plain = F.regexp_replace(path, "^file:/+", "file:/")
    of = [F.when(F.startswith(plain, F.lit(f"{root}/")), F.lit(m)) for m, root in roots.items()]
    return spark.read.text(wanted, wholetext=True).select(
        F.explode(F.array_compact(F.array(*of))).alias("model"),
        F.col("_metadata.file_modification_time").alias("modified"),
        path.alias("path"),
        _document(F.col("value"), path).alias("body"),
    )


def find_latest_results(spark: SparkSession, model_dirs: Mapping[str, str]) -> DataFrame:
    """The newest result document of each model; a model without any has no row."""
    return latest_results(scan_results(spark, model_dirs))


def load_metrics(spark: SparkSession, path: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """``(model, task, value)`` from one metrics document holding a map per stage."""
    fields = ", ".join(f"`{s}`: map<string,double>" for s in stages)
    body = spark.read.text(files.literal(path), wholetext=True).select(F.from_json("value", f"struct<{fields}>").alias("m"))
    per_stage = F.array(*[F.struct(F.lit(s).alias("model"), F.col("m")[s].alias("tasks")) for s in stages])
    return (
        body.select(F.explode(per_stage).alias("stage"))
        .select("stage.model", F.explode("stage.tasks").alias("task", "value"))
    )
