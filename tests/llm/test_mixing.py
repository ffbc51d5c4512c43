import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnwise.llm.mixing import MixOptions, mix_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, options=MixOptions()):
    """Targets by one sorted pass, rows of each source sorted by place: ``(doc_id, size, source_size, target, taken)``."""
    measured = []
    for doc_id, text, source in rows:
        key = f"{'' if doc_id is None else doc_id}\n{text or ''}"
        place = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        measured.append((source, place, len(WORDS.findall(text or "")), doc_id))
    totals = defaultdict(int)
    for source, _, size, _ in measured:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: options.weights[i % len(options.weights)] for i, s in enumerate(order)}
    budget, left = sum(totals.values()) * options.percent / 100, set(order)
    held = 0
    while left:
        share = (budget - held) / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * share > options.most * totals[s]}
        if not above:
            break
        held += sum(options.most * totals[s] for s in above)
        left -= above
    target = {s: weight[s] * share if s in left else float(options.most * totals[s]) for s in order}
    out = []
    for source in order:
        times = int(target[source] // totals[source]) if totals[source] else 0
        rest = target[source] - times * totals[source]
        groups = defaultdict(list)
        for s, place, size, doc_id in measured:
            if s == source:
                groups[place].append((doc_id, size))
        upto, more = 0, True
        for place in sorted(groups):
            size = sum(n for _, n in groups[place])
            if more and upto + size > rest:
                more = False
                again = upto + size - rest < rest - upto
            else:
                again = more
            upto += size
            out += [(i, n, totals[source], target[source], n * (times + again)) for i, n in groups[place]]
    return out


def keyed(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def mixed(df, options=MixOptions()):
    return keyed(tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in mix_documents(df, options).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def sources(n=600):
    rows = [(i, f"w{i} " * (i * 37 % 50), ["a", "B", "é", "z", None, "", "日"][i % 7 if i % 3 else 0]) for i in range(n)]
    return [*rows, (None, "a b", "a"), (None, None, "none at all"), (None, "", "none at all"), (3, "x y z", None)]


@pytest.mark.parametrize(
    "options",
    [
        MixOptions(),
        MixOptions(level_bits=1),
        MixOptions(level_bits=16, weights=(1,), percent=40),
        MixOptions(weights=(9, 1), percent=290, most=3),
        MixOptions(percent=200),
        MixOptions(percent=0),
    ],
)
def test_mix_is_that_of_sorted_rows(spark, options):
    rows = sources()
    got = mixed(table(spark, rows).repartition(5), options)
    wanted = keyed(brute_force(rows, options))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in wanted]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in wanted])


def test_targets_are_met_and_no_row_is_taken_too_often(documents):
    got = mix_documents(documents, carry=("doc_id", "source"))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.max("size").alias("largest"))
    for r in per.collect():
        assert abs(r.t - r.goal) <= r.largest
    assert got.filter(F.col("taken") > 2 * F.col("size")).isEmpty()


def test_smaller_budgets_take_part_of_larger_ones(spark):
    df = table(spark, sources())
    taken = [
        {r.doc_id: r.times for r in mix_documents(df, MixOptions(percent=p)).filter("doc_id is not null and doc_id <> 3").collect()}
        for p in (20, 90, 150)
    ]
    assert all(a[i] <= b[i] for a, b in zip(taken, taken[1:], strict=False) for i in a)


def test_reruns_and_partitions_agree(spark):
    df = table(spark, sources())
    assert mixed(df.repartition(1)) == mixed(df.repartition(7))


def test_copies_and_a_hot_source(spark):
    rows = [(i, "the same words in all of them", "hot") for i in range(900)] + [(900 + i, "few words", f"s{i}") for i in range(40)]
    rows += [(7, "a row that occurs often", "rows")] * 50
    assert mixed(table(spark, rows)) == keyed(brute_force(rows))


def test_odd_rows_clashing_names_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert mixed(odd.withColumn("source", F.col("lang"))) == keyed(brute_force(rows))
    assert mix_documents(empty.withColumn("source", F.lit("x"))).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", 9, "x")], "doc_id long, text string, source string, size int, mix_place string")
    got = mix_documents(clash, carry=("doc_id", "text", "size", "mix_place")).first()
    assert (got.text, got.size, got.mix_place) == ("a b", 2, "x")
