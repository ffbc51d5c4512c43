"""Quality classifier, language identification, quality rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import language_id, quality_classifier, quality_rules, subword
from turnwise.llm.queries import op1_quality, op3_language, op8_quality_rules

SMALL = subword.SubwordOptions(sample=400, visits=3000)
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def test_held_out_quality(spark, folder):
    rows = op1_quality(spark, LARGER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.95


def test_held_out_language(spark, folder):
    rows = op3_language(spark, LARGER).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97 and all(r.lang_pred in set(langs.values()) | {"und"} for r in rows)


def test_models_do_not_depend_on_row_order(documents):
    labels = documents.select("doc_id", F.col("lang").alias("label"))
    a = subword.bounded_sample(documents, labels, SMALL)
    b = subword.bounded_sample(documents.repartition(7), labels.repartition(3), SMALL)
    assert a == b


def test_sample_is_bounded(documents):
    labels = documents.select("doc_id", F.col("lang").alias("label"))
    texts, _ = subword.bounded_sample(documents, labels, subword.SubwordOptions(sample=20))
    assert 0 < len(texts) <= 20
    texts, _ = subword.bounded_sample(documents, labels, subword.SubwordOptions(sample_chars=5000))
    assert sum(map(len, texts)) <= 5000


def test_long_texts_leave_room_for_the_others(spark):
    """Texts above the budget, or that use most of it, at the first places."""
    ids = [r[0] for r in spark.range(200).orderBy(F.xxhash64("id")).collect()]
    sizes = {ids[0]: 20000, ids[1]: 6000, ids[2]: 3900}
    rows = [(i, f"text {i} ".ljust(sizes.get(i, 40), "x"), "en" if i % 2 else "fr") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    o = subword.SubwordOptions(sample=150, sample_chars=12800)
    texts, labels = subword.bounded_sample(docs, docs.select("doc_id", "label"), o)
    assert len(texts) == 150 and set(labels) == {"en", "fr"}
    some = docs.filter(F.col("doc_id").isin(ids[:10]))
    texts, _ = subword.bounded_sample(some, some.select("doc_id", "label"), o)
    assert sorted(map(len, texts)) == [40] * 7 + [3900, 6000]


def test_rare_labels_and_copies_in_the_sample(spark):
    """One row in 500 has the rare label, a third of the rows are copies of one text."""
    label = F.when(F.col("id") % 500 == 7, "rare").when(F.col("id") % 4 == 0, "b").otherwise("a")
    text = F.when((F.col("id") % 3 == 0) & (label == "a"), "copy").otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), label.alias("label"))
    texts, labels = subword.bounded_sample(docs, docs.select("doc_id", "label"), subword.SubwordOptions(sample=100))
    assert len(texts) == 100 and texts.count("copy") <= 1
    found = Counter(labels)
    assert found["rare"] == min(100 // 6, 12) and found["a"] > found["b"] > 16


def test_language_of_odd_rows(odd, empty, documents):
    labels = documents.select("doc_id", F.col("lang").alias("label"))
    model = language_id.fit_language(documents, labels, SMALL)
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in language_id.identify(odd, model).collect()]
    assert len(got) == odd.count()
    for doc_id, lang, score, rejected in got:
        assert (lang == "und") == (doc_id in (1, 2, 3, 4)) and 0 <= score <= 1
        assert rejected or lang != "und"
    assert language_id.keep_identified(odd, model).columns == odd.columns
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit_language(empty, empty.select("doc_id", F.col("lang").alias("label")))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_quality_of_odd_rows_and_poor_models(odd, empty, documents):
    labels = odd.select("doc_id", F.lit(1).alias("label"))
    one = quality_classifier.fit_quality(odd, labels, SMALL)
    assert {r.score for r in quality_classifier.quality_scores(odd, one).collect()} == {1.0}
    none = quality_classifier.fit_quality(empty, empty.select("doc_id", F.lit(1).alias("label")), SMALL)
    assert {r.score for r in quality_classifier.quality_scores(odd, none).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, one).count() == 0


def test_word_features_against_brute_force():
    words = ["a", "añb", "日本", "abcdef"]
    rows, counts = subword.word_features(words, subword.SubwordOptions())
    for word, n in zip(words, counts, strict=True):
        size = len(word) + 2
        assert n == 1 + sum(max(0, size - k + 1) for k in (2, 3, 4))
    alone = np.concatenate([subword.word_features([w], subword.SubwordOptions())[0] for w in words])
    assert rows.tolist() == alone.tolist()


def test_a_slice_without_words_has_the_bias_alone():
    o = subword.SubwordOptions()
    model = subword.SubwordModel(np.ones((o.buckets, 2), np.float32), np.array([0.25, -0.25]), ("a", "b"), o)
    assert np.ptp(subword.document_logits(model, pa.array(["", " "], pa.large_string())), axis=0).tolist() == [0, 0]


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_op8_base_against_brute_force(spark, folder, documents):
    got = {r.doc_id: r for r in op8_quality_rules(spark, folder).collect()}
    for r in documents.collect():
        g, want = got[r.doc_id], base_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.kept and g.base_failed)


def test_rules_keep_good_documents(spark, folder):
    rows = op8_quality_rules(spark, LARGER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(r.kept for r in good)
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 0]) < 0.4


def test_odd_rows_of_the_rules(odd, empty):
    got = quality_rules.judge_documents(odd).collect()
    assert len(got) == odd.count()
    texts = Counter(base_counts(r.text) for r in odd.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
    assert quality_rules.judge_documents(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_expectation_maximisation_finds_the_accuracies():
    random = np.random.default_rng(5)
    good = random.random(40000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(random.random(len(good)) < a, good, ~good).astype(int) for a in right], axis=1)
    votes[random.random(votes.shape) < 0.2] = -1
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    model = quality_rules.fit_votes(patterns, 4)
    assert model.good == pytest.approx(0.8, abs=0.03)
    assert model.right_on_good == pytest.approx(right, abs=0.03)
    assert model.right_on_bad == pytest.approx(right, abs=0.06)


def test_repeated_windows_of_long_and_short_texts():
    from turnwise.llm.arrow_text import word_codes

    texts = ["", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z x y", "p q r s p q r", " a  b\tc\na b c "]
    codes, starts, _ = word_codes(pa.array(texts, pa.large_string()))
    assert quality_rules.repeated_window_words(codes, starts).tolist() == [base_counts(t)[4] for t in texts]
