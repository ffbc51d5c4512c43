"""Every token before has a restaurant of its own, whatever its rank, and its totals over all buckets are exact."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import pitman_yor
from turnwise.llm.arrow_text import release_shuffles, stored
from turnwise.llm.pitman_yor import ModelOptions


def test_a_rare_token_before_is_not_merged_with_others(spark):
    """1,500 tokens with one ending, each followed by its own token: more than any list of frequent ones held."""
    pairs = [(i, f"a{i}xx b{i}yy") for i in range(1500)]
    learned = [(10 * i + k, text) for i, text in pairs for k in range(3)]
    right = [(100_000 + i, text) for i, text in pairs[::50]]
    wrong = [(200_000 + i, f"a{i}xx b{(i + 7) % 1500}yy") for i, _ in pairs[::50]]
    df = spark.createDataFrame(learned + right + wrong, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in pitman_yor.score_documents(df, F.col("doc_id") >= 100_000).collect()}
    gains = [rows[i] - rows[i + 100_000] for i, _ in right]
    assert min(gains) > 1.5  # thirty times as likely at least


@pytest.mark.parametrize("buckets", [1, 5])
def test_customers_of_a_restaurant_are_its_seats_and_tables(spark, documents, buckets):
    """What every block gets back adds up: discounted customers and tables of a token are its learned occurrences."""
    o = ModelOptions(samples=2, burn_in=1)
    blocks = pitman_yor._block_rows(documents.limit(80).coalesce(1), F.lit(False), o).cache()
    found = pitman_yor._totals(pitman_yor._requests(blocks, buckets), buckets, o).cache()
    sums = np.sum([r.totals for r in found.filter("bucket < 0").collect()], axis=0)
    totals = pitman_yor.Totals(int(sums[0]), sums[1:].reshape(o.samples, -1))
    opened = found.filter("bucket >= 0").select("bucket", "origin", "opened")
    answers = pitman_yor._answers(pitman_yor._requests(blocks, buckets), opened, buckets, o, totals).orderBy("bucket").collect()
    (row,) = blocks.collect()
    block = pitman_yor.Block(row.tokens, np.array(row.counts), buckets)
    parts = [pitman_yor._unpack(r.answer) for r in answers]
    count, tables, seats, chance = (np.concatenate([p[i] for p in parts]).astype(float) for i in range(4))
    own = block.place[block.before]
    assert np.bincount(own, weights=seats, minlength=len(count)) + tables == pytest.approx(count, rel=1e-4, abs=1e-3)
    assert (chance > 0).all() and (tables > 0).all() and (seats > 0).all()
    assert {r.bucket for r in answers} == set(block.bucket.tolist())


def test_recurring_floats_are_packed_as_places_and_come_back_unchanged():
    random = np.random.default_rng(5)
    arrays = [
        random.choice(random.random(50).astype(np.float32), 20_000), random.random(300).astype(np.float32), np.zeros(0, np.float32),
        np.sort(random.integers(0, 1 << 63, 400).astype(np.uint64)), random.integers(0, 9, 500).astype(np.uint8),
    ]
    for a, b in zip(arrays, pitman_yor._unpack(pitman_yor._pack(arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    assert len(pitman_yor._pack(arrays[:1])) < 20_000  # less than a byte each; byte planes alone took nearly three


def test_the_shuffle_of_the_last_write_is_released(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = files()
    written, _ = stored(spark.range(5000).repartition(3, "id"), "released")
    made = files() - before
    release_shuffles(spark, 2.0)
    assert made and not made & files()
    assert written.count() == 5000
