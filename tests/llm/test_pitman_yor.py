"""The language model: exact counts and base, seating, probabilities that sum to one, better scores than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import pitman_yor
from turnwise.llm.pitman_yor import ModelOptions
from turnwise.llm.queries import op5_pitman_yor

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def nobody():
    return F.lit(False)


def check_base(rows, texts, held):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), ""] for i, t in texts}
    counts = Counter(w for i, words in tokens.items() if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows}
    assert got.keys() == tokens.keys()
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score <= 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(words)))


def test_op5_counts_and_held_out_perplexity(spark, folder, documents):
    rows = op5_pitman_yor(spark, folder).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.collect()], lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_every_restaurant_sum_to_one():
    """Over all dishes and the unknown one, from the seating of one bucket and its totals."""
    random = np.random.default_rng(8)
    dishes, e, f = 40, 4, 6
    o = ModelOptions(endings=e, samples=1)
    layout = pitman_yor.Layout(np.arange(f, dtype=np.uint64), random.integers(0, e, f), e, 1)
    pairs = np.unique(random.integers(0, dishes * (e + f), 300))
    dish, restaurant = np.divmod(pairs, e + f)
    s = pitman_yor.seat_bucket(dish, restaurant, random.integers(0, 90, len(pairs)), dishes, layout, o, 0)
    sample, total = s["samples"][0], s["samples"][0]["totals"]
    vocabulary = int((s["count"] > 0).sum())
    known = s["count"] > 0
    p1 = (sample["root"] + (o.strength + total[1]) / (vocabulary + 1)) / (o.strength + total[0])
    unknown = (o.strength + total[1]) / (vocabulary + 1) / (o.strength + total[0])
    assert p1[known].sum() + unknown == pytest.approx(1)
    shared = np.zeros((dishes, e))
    own = np.zeros((dishes, f))
    behind = np.where(restaurant >= e, layout.behind[np.maximum(restaurant - e, 0)], restaurant)
    shared[dish, behind] = sample["shared"][s["to_shared"]]
    own[dish[s["fine"]], restaurant[s["fine"]] - e] = sample["fine"]
    sat2, open2 = total[2 : 2 + e], total[2 + e : 2 + 2 * e]
    p2 = (shared + (o.strength + open2) * p1[:, None]) / (o.strength + sat2)
    u2 = (o.strength + open2) * unknown / (o.strength + sat2)
    assert p2[known].sum(axis=0) + u2 == pytest.approx(np.ones(e))
    sat3, open3 = total[2 + 2 * e : 2 + 2 * e + f], total[2 + 2 * e + f :]
    p3 = (own + (o.strength + open3) * p2[:, layout.behind]) / (o.strength + sat3)
    u3 = (o.strength + open3) * u2[layout.behind] / (o.strength + sat3)
    assert p3[known].sum(axis=0) + u3 == pytest.approx(np.ones(f))
    assert (p3 > 0).all()


def test_odd_rows(spark, odd, empty):
    unique = odd.filter("doc_id IS NOT NULL AND doc_id NOT IN (5, 9)")
    check_base(pitman_yor.score_documents(unique, nobody()).collect(), [(r.doc_id, r.text) for r in unique.collect()], lambda i: False)
    every = pitman_yor.score_documents(odd, F.col("doc_id") == 8).collect()
    assert len(every) == odd.count()
    same = [r.score for r in every if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert pitman_yor.score_documents(empty, nobody()).count() == 0
    nothing = pitman_yor.score_documents(unique, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in nothing)


def test_results_do_not_depend_on_partitions(spark, documents):
    some = documents.limit(60)
    one = ModelOptions(frequent=8, samples=1, burn_in=0)
    a = {r.doc_id: r.base_score for r in pitman_yor.score_documents(some.repartition(1), nobody(), one).collect()}
    b = {r.doc_id: r.base_score for r in pitman_yor.score_documents(some.repartition(6), nobody(), one).collect()}
    assert a == pytest.approx(b)


def test_stirling_numbers_count_seatings():
    """S(c, t) with discount 0 are the unsigned Stirling numbers of the first kind."""
    s = np.exp(pitman_yor.log_stirling(0.0, 6))
    assert s[4, 1:5].round(6).tolist() == [6, 11, 6, 1]
    assert s[5, 1:6].round(6).tolist() == [24, 50, 35, 10, 1]


@pytest.mark.parametrize(("customers", "opening", "discount"), [(2, 0.5, 0.5), (7, 3.0, 0.3), (40, 1.5, 0.8)])
def test_tables_follow_their_conditional(customers, opening, discount):
    random = np.random.default_rng(3)
    drawn = pitman_yor.draw_tables(np.full(20000, customers), np.full(20000, opening), discount, random)
    t = np.arange(1, customers + 1)
    p = np.exp(np.log(opening) * t + pitman_yor.log_stirling(discount, 64)[customers, 1 : customers + 1])
    assert drawn.mean() == pytest.approx((p / p.sum() * t).sum(), rel=0.03)
    assert drawn.min() >= 1 and drawn.max() <= customers


def test_many_customers_are_seated_in_groups():
    random = np.random.default_rng(3)
    drawn = pitman_yor.draw_tables(np.full(500, 100000), np.full(500, 20.0), 0.0, random)
    assert drawn.mean() == pytest.approx(20 * math.log(1 + 100000 / 20), rel=0.1)
    assert pitman_yor.draw_tables(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, random).tolist() == [0, 1]
