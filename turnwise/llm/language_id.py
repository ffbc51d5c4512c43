"""Language of documents by supervised subword embeddings, with a calibrated rejection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.subword import SubwordModel, SubwordOptions, bounded_sample, scored, train

UNKNOWN = "und"


def fit_language(documents: DataFrame, labels: DataFrame, options: SubwordOptions | None = None) -> SubwordModel:
    """Learns `label` of (doc_id, label) from `text` in lower case, on a sample bounded by the options."""
    o = replace(options or SubwordOptions(), lower=True)
    return train(*bounded_sample(documents, labels, o), o)


def language(text: Column, model: SubwordModel, spark: SparkSession) -> Column:
    """Struct of lang_pred, score and rejected from a whole text.

    `und` with score 0, rejected, if the text is null or has no letter, or if no language was learned. Otherwise the
    likeliest language with its calibrated probability; rejected if that is below the calibrated least confidence.
    """
    found = scored(F.when(text.rlike(r"\p{L}"), text), model, spark)  # a text without letters counts as null
    blank = found.getField("label").isNull() | found.getField("wordless")
    return F.struct(
        F.when(blank, F.lit(UNKNOWN)).otherwise(found.getField("label")).alias("lang_pred"),
        F.when(blank, F.lit(0.0)).otherwise(found.getField("score")).alias("score"),
        (blank | (found.getField("score") < model.reject_below)).alias("rejected"),
    )


def identify(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text; see `language`. Narrow."""
    return documents.select("doc_id", language(F.col("text"), model, documents.sparkSession).alias("x")).select("doc_id", "x.*")


def keep_identified(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    return documents.filter(~language(F.col("text"), model, documents.sparkSession).getField("rejected"))
