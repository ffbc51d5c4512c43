"""Scores of the classifiers against a word-by-word calculation in plain integers."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import language_id, quality_classifier, subword
from turnwise.llm.queries import op1_quality, op3_language

MASK, FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def features(word, o):
    points = [ord(c) for c in f"\x02{word}\x03"]
    rows = [mix(sum(mix(p) * pow(FACTOR, i + 1, 1 << 64) for i, p in enumerate(points)) & MASK)]
    for n in range(o.shortest, o.longest + 1):
        for i in range(len(points) - n + 1):
            rolled = 0
            for p in points[i : i + n]:
                rolled = (rolled * FACTOR + p) & MASK
            rows.append(mix((rolled + n) & MASK))
    return [r % o.buckets for r in rows]


def probabilities(text, model):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if model.options.lower:
        words = [w.lower() for w in words]
    rows = []
    for k, word in enumerate(words):
        if k and words[k - 1] == word:
            rows += features("", model.options)
        rows += features(word, model.options)
    logits = model.bias + (model.logits[rows].astype(float).mean(axis=0) if rows else 0)
    e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
    return np.array(e) / sum(e)


SMALL = subword.SubwordOptions(sample=120, visits=600)


def test_quality_by_word(spark, documents):
    labels = documents.select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    model = quality_classifier.fit_quality(documents, labels, SMALL)
    rows = [(r.doc_id, r.text) for r in documents.limit(40).collect()] + [(900, None), (901, ""), (902, "a a a b b")]
    got = quality_classifier.quality_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model)
    good = model.labels.index("1")
    want = {i: probabilities(t, model)[good] for i, t in rows}
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5) and r.predicted == (r.score >= 0.7)


def test_language_by_word(spark, documents):
    model = language_id.fit_language(documents, documents.select("doc_id", F.col("lang").alias("label")), SMALL)
    rows = [(r.doc_id, r.text) for r in documents.limit(40).collect()] + [(902, "the the The"), (903, "12 the 34")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model)
    want = {i: probabilities(t, model) for i, t in rows}
    for r in got.collect():
        p = want[r.doc_id]
        assert r.lang_pred == model.labels[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-5)
        assert r.rejected == (r.score < model.reject_below)


def test_rows_without_an_id_are_not_held_out(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    odd.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    for query in (op1_quality, op3_language):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == odd.count() and all(isinstance(r.held_out, bool) for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
