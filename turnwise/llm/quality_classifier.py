"""Quality of documents by supervised subword embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.subword import SubwordModel, SubwordOptions, bounded_sample, scored, train


def fit_quality(documents: DataFrame, labels: DataFrame, options: SubwordOptions | None = None) -> SubwordModel:
    """Learns `label` (0 or 1) of (doc_id, label) from the documents' `text`, on a sample bounded by the options."""
    o = options or SubwordOptions()
    return train(*bounded_sample(documents, labels, o), o)


def quality_scores(documents: DataFrame, model: SubwordModel, good: str = "1", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted): probability of the good label for every whole text, and 1 from the threshold on.

    A null or empty text is scored by the bias, a model that never saw the good label scores 0, one that saw nothing 0.5.
    """
    if not model.labels:
        score = F.lit(0.5)
    elif good not in model.labels:
        score = F.lit(0.0)
    else:
        found = scored(F.col("text"), model, documents.sparkSession)
        score = F.get(found.getField("scores"), F.lit(model.labels.index(good)))
    rows = documents.select("doc_id", score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
