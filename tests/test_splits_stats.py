import hashlib
import math

import pytest
from pyspark.sql import functions as F

from turnwise.operators import filters, ordering, splits, stats, tokens


def hashed(i, seed):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


def members(df, split="validation"):
    return {r.row_id for r in df.filter(F.col("split") == split).collect()}


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_id")


@pytest.mark.parametrize("n,size,seed", [(1, 0.02, 42), (50, 0.02, 42), (500, 0.1, 7), (1001, 0.02, 0), (100, 1.0, 1), (100, 0.0, 1)])
def test_exact_split_against_a_full_sort(spark, n, size, seed):
    expected = set(sorted(range(n), key=lambda i: hashed(i, seed))[: math.ceil(n * size)])
    for prefix in (1, 4):
        got = splits.exact_split(ids(spark, n), "row_id", size, seed, prefix)
        assert members(got) == expected
        assert members(got, "train") == set(range(n)) - expected


def test_exact_split_of_nothing(spark):
    assert splits.exact_split(ids(spark, 0)).count() == 0


def test_split_is_independent_of_partitioning_and_moves_with_the_seed(spark):
    df = ids(spark, 400)
    assert members(splits.exact_split(df.repartition(1))) == members(splits.exact_split(df.repartition(13)))
    assert members(splits.exact_split(df, seed=1)) != members(splits.exact_split(df, seed=2))


def test_repeated_ids_stay_together(spark):
    df = ids(spark, 100).union(spark.range(200).selectExpr("5L row_id"))
    got = splits.exact_split(df, test_size=0.5, prefix=1)
    assert got.filter("row_id = 5").select("split").distinct().count() == 1
    assert got.count() == 300


def test_split_does_not_shuffle_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    ids(spark, 100).withColumn("wide", F.repeat(F.lit("x"), 100)).write.parquet(path)
    plan = splits.exact_split(spark.read.parquet(path))._jdf.queryExecution().executedPlan()
    main = plan.toString().split("Subquery")[0]
    assert "Exchange" not in main


def test_hash_split(spark):
    got = members(splits.hash_split(ids(spark, 2000), test_size=0.1, seed=3))
    assert got == {i for i in range(2000) if int(hashed(i, 3)[:8], 16) / 2**32 < 0.1}
    assert 120 < len(got) < 280


def test_preference_split_keeps_existing_parts(spark):
    df = ids(spark, 10).withColumn("split", F.lit("train"))
    assert members(splits.preference_split(df), "train") == set(range(10))
    assert len(members(splits.preference_split(ids(spark, 100)))) == 2


def test_seeded_index(spark):
    got = {r.row_id: r["index"] for r in ordering.seeded_index(ids(spark, 333), "row_id", 5, 1).collect()}
    expected = {i: at for at, i in enumerate(sorted(range(333), key=lambda i: hashed(i, 5)))}
    assert got == expected


def test_stats(spark):
    df = spark.createDataFrame([("train", [1, 2]), ("train", [1, 2, 3, 4]), ("validation", [1])], "split string, input_ids array<int>")
    got = {r.split: tuple(r)[1:] for r in stats.length_stats(df, by="split").collect()}
    assert got == {"train": (2, 2, 4, 3.0), "validation": (1, 1, 1, 1.0)}
    assert tuple(stats.length_stats(df.limit(0)).first()) == (0, None, None, None)
    assert {r.split: r.n_rows for r in stats.split_counts(df).collect()} == {"train": 2, "validation": 1}
    assert stats.row_total(df).first().n_rows == 3


def test_preview_columns(spark):
    df = spark.createDataFrame([(2, "t2", "i" * 60), (1, "t1", "short")], "row_id bigint, text string, instruction string")
    assert [r.preview for r in stats.preview(df).collect()] == ["short...", "i" * 50 + "..."]
    assert [r.preview for r in stats.preview(df.drop("instruction"), n=1).collect()] == ["t1..."]
    whole = stats.preview(df.select("row_id", F.col("text").alias("x")), width=80).first().preview
    assert whole == '{"row_id":1,"x":"t1"}...'


def test_checks(spark):
    checks = stats.table_checks({"full": spark.range(3), "empty": spark.range(0)})
    assert {r.check: (r.n_rows, r.passed) for r in checks.collect()} == {"full": (3, True), "empty": (0, False)}
    assert stats.all_passed(checks).first().all_passed is False
    assert stats.all_passed(checks.filter("passed")).first().all_passed is True


def test_preference_budget(spark):
    df = spark.createDataFrame([(1, "abc", "a", "bbbb"), (2, "abcdef", "a", "b")], "row_id bigint, prompt string, chosen string, rejected string")
    got = {r.row_id: (r.prompt_fits, r.pair_fits) for r in filters.preference_budget(df, tokens.ByteEncoder(), 5, 7).collect()}
    assert got == {1: (True, True), 2: (False, True)}
    tight = filters.preference_budget(df, tokens.ByteEncoder(), 5, 6).filter("row_id = 1").first()
    assert tight.prompt_fits and not tight.pair_fits


def test_allowed_tasks(spark):
    df = spark.createDataFrame([("gsm8k",), ("piqa",), ("own",)], "task string")
    assert {r.task for r in filters.allowed_tasks(df, " gsm8k,\tmmlu\n").collect()} == {"gsm8k"}
    assert {r.task for r in filters.allowed_tasks(df).collect()} == {"gsm8k", "piqa"}
