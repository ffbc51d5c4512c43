"""A corpus pipeline of the llm operators: each stage's rows are written as parquet and read again by the next one.

Quality rules drop what their label model holds for junk, language identification drops what it rejects, of each group of
near duplicates one document stays, and what is left is packed into sequences.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from turnwise.llm.arrow_text import shared_folder, table, written  # noqa: E402
from turnwise.llm.language_id import keep_identified  # noqa: E402
from turnwise.llm.minhash_dedup import DedupOptions, keep_one_of_each  # noqa: E402
from turnwise.llm.packing import pack_documents  # noqa: E402
from turnwise.llm.quality_rules import keep_good  # noqa: E402
from turnwise.llm.queries import learn_language  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from three quarters of the documents that are left."""
    return keep_identified(docs, learn_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, resemblance of 0.8 and more."""
    return keep_one_of_each(docs, DedupOptions(percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 ids from all the documents left: one row per piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("packing", packing),
]
ORACLE_SQL = None  # the label model, the classifier, the signatures and the packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), shared_folder(spark, f"stage-{name.replace(' ', '-')}"))
    return docs
