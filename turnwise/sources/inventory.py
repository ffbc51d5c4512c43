"""File counts and sizes per corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.operators.stats import size_summary
from turnwise.sources import files

FILES = "corpus string, path string, length bigint"


def file_inventory(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """``(corpus, path, length)``; a corpus whose folder is absent has one row with NULL path.

    Directories are named explicitly, so those that begin with an underscore count too. Files with hidden-looking names,
    which the scan leaves out, are added from the listing. File contents are not read.
    """
    listed = spark.createDataFrame([(c,) for c in folders], "corpus string")
    found, hidden = spark.createDataFrame([], FILES), []
    for corpus, folder in folders.items():
        if not files.exists(spark, folder):
            continue
        below = files.walk(spark, folder)
        hidden += [(corpus, f.path, f.length) for f in below if f.name.startswith(("_", ".")) or "_COPYING_" in f.name]
        parents = sorted({f.path.rsplit("/", 1)[0] for f in below})
        if parents:
            scan = spark.read.format("binaryFile").load([files.literal(p) for p in parents])
            found = found.unionByName(scan.select(F.lit(corpus).alias("corpus"), "path", "length"))
    whole = found.unionByName(spark.createDataFrame(hidden, FILES)).dropDuplicates(["corpus", "path"])
    return listed.join(whole, "corpus", "left")


def corpus_sizes(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    return size_summary(file_inventory(spark, folders))
