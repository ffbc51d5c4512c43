"""Joins with hot keys, positions in a given order, vocabularies with many rare tokens, tables that are replaced."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators import labels, tokens, turn_examples, turns
from turnwise.operators.hot import hot_join, hot_keys
from turnwise.operators.ordering import dense_positions
from turnwise.plans import prepare
from turnwise.sources import files, results

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def uneven(spark):
    """Half the rows have one key, a tenth a NULL."""
    key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50)
    return spark.range(0, 4000, 1, 4).select("id", key.alias("k"), (F.col("id") % 3).alias("m"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_the_join(spark, uneven, how):
    table = spark.createDataFrame([(7, "seven"), (7, "again"), (3, "three"), (None, "none"), (99, "x")], "k bigint, v string")
    assert [r.k for r in hot_keys(uneven.dropna(), ["k"], 4).collect()] == [7]
    want = rows_of(uneven.join(table, ["k"], how).select("id", "k", "m", "v"))
    assert rows_of(hot_join(uneven, table, ["k"], how).select("id", "k", "m", "v")) == want
    renamed = table.withColumnRenamed("k", "of")
    want = rows_of(uneven.join(renamed, F.col("k").eqNullSafe(F.col("of")), how).select("id", "k", "m", "v"))
    assert rows_of(hot_join(uneven, table, ["k"], how, null_safe=True).select("id", "k", "m", "v")) == want


def test_hot_key_is_dealt_over_tasks(spark, uneven):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(c, v)
    try:
        table = spark.range(50).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        met = hot_join(uneven.dropna().select("id", "k"), table, ["k"])
        held = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) == 4 and max(held) < 2 * sorted(held)[1]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_positions_in_any_order(spark):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") * 7919 % 3000).alias("v"), F.lit("x").alias("w"))
    got = dense_positions(df, [F.desc("v")]).collect()
    assert sorted((r.position, r.v) for r in got) == [(i, 2999 - i) for i in range(3000)]
    assert dense_positions(df.limit(0), [F.desc("v")]).count() == 0


def test_a_million_rare_tokens_with_one_beginning(spark):
    texts = spark.range(0, 1000, 1, 8).select(
        F.concat(F.lit("the "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(F.lit("zz"), (F.col("id") * 1000 + k).cast("string"))), " ")).alias("text")
    )
    vocabulary = tokens.build_vocabulary(texts, None)
    low, high, n, distinct = vocabulary.agg(F.min("id"), F.max("id"), F.count("id"), F.countDistinct("id")).first()
    assert (low, high, n, distinct) == (0, 1_000_000, 1_000_001, 1_000_001)
    assert vocabulary.filter("id = 0").first().token == "the"
    ordered = sorted(f"zz{i}" for i in range(1_000_000))
    assert {r.token: r.id for r in vocabulary.filter("id % 99991 = 5").collect()} == {ordered[i - 1]: i for i in range(5, 1_000_001, 99991)}


def test_join_encoder_with_small_blocks_and_frequent_unknown_tokens(spark):
    texts = [(i, None if i % 17 == 0 else f"a b{i % 7} unknown unknown c{i}" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(texts, "row_id bigint, text string").repartition(5)
    vocabulary = ["a", *[f"b{k}" for k in range(7)], "c5", "c11a"]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "token string, id int")
    native = {r[0]: r[1] for r in df.select("row_id", tokens.RegexEncoder(vocabulary, 99).ids(F.col("text"))).collect()}
    for head in (0, 3):
        got = tokens.encode_by_join(df, table, unknown_id=99, head=head, block=1)  # a row is a block: "unknown" is in most
        assert {r[0]: r[1] for r in got.collect()} == native
    cut = tokens.encode_by_join(df, table, unknown_id=99, max_length=3)
    assert {r[0]: r[1] for r in cut.collect()} == {i: v and v[:3] for i, v in native.items()}


def test_labels_from_a_vocabulary_table(spark):
    rows = [(i, [("user", f"q {i} a"), ("assistant", f"a b {i}"), ("user", "more"), ("assistant", "z")]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, messages array<struct<role:string,content:string>>")
    vocabulary = ["<|im_start|>", "<|im_end|>", "user", "assistant", "a", "b", "q", "7"]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "token string, id int")
    shipped, joined = tokens.RegexEncoder(vocabulary), tokens.TableEncoder(table, head=2)
    marks = tokens.SpecialIds(bos=100, eos=101)
    for compat in (False, True):
        for limit in (6, 4096):
            want = labels.completion_examples(df, shipped, limit, marks, compat=compat).drop("messages")
            got = labels.completion_examples(df, joined, limit, marks, compat=compat).drop("messages")
            assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert rows_of(labels.full_examples(df, joined, 9).drop("messages")) == rows_of(labels.full_examples(df, shipped, 9).drop("messages"))
    with pytest.raises(TypeError, match="with_ids"):
        joined.ids(F.col("text"))
    assert joined.identity() == tokens.TableEncoder(table.repartition(3)).identity() != shipped.identity()


@pytest.mark.parametrize("limit", [5, 40, 4096])
def test_compat_labels_from_turns(spark, limit):
    rows = [(c, t, r, f"{r} {c} " * (c % 4 + 1)) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user"][: 1 + c % 4])]
    df = spark.createDataFrame([*rows, (None, 0, "user", "no conversation"), (3, None, "user", "no number")], TURNS)
    whole = turns.messages_from_turns(df).select("conv_id", "messages")
    for encoder in (tokens.ByteEncoder(), tokens.RegexEncoder(["user"])):
        want = rows_of(labels.completion_examples(whole, encoder, limit, compat=True).drop("messages"))
        assert rows_of(turn_examples.examples_from_turns(df, encoder, limit, compat=True)) == want


def test_a_conversation_is_one_row_while_it_fits(spark):
    long = spark.range(3000).selectExpr("1L conv_id", "id turn", "'user' role", "concat('t', id) text")
    got = turns.messages_from_turns(long).collect()
    assert [(r.part, r.n_parts, len(r.messages)) for r in got] == [(0, 1, 3000)]
    assert [m.content for m in got[0].messages] == [f"t{i}" for i in range(3000)]
    parts = turns.messages_from_turns(long, row_bytes=100_000).orderBy("part").collect()
    assert [len(r.messages) for r in parts] == [1024, 1024, 952]
    assert [m.content for r in parts for m in r.messages] == [f"t{i}" for i in range(3000)]


def test_a_build_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert prepare.read_or_build(spark, path, lambda: spark.range(3), "a").count() == 3
    broken = spark.range(8).select(F.when(F.col("id") == 5, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        prepare.read_or_build(spark, path, lambda: broken, "b")
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    assert prepare.read_or_build(spark, path, lambda: spark.range(9), "a").count() == 3
    assert prepare.read_or_build(spark, path, lambda: spark.range(9), "b").count() == 9
    files.move(spark, path, path + files.REPLACED)  # as an interruption between the two renames leaves it
    assert prepare.read_or_build(spark, path, lambda: spark.range(1), "b").count() == 9


def test_results_of_all_models_are_one_scan(spark, tmp_path):
    body = '{"results": {"t": {"acc,none": %s}}, "date": 1}'
    for i, place in enumerate(["base/__x y/results_1.json", "sft/results_2.json", "dpo/a/.b/c/results_3.json", "dpo/a/other.json"]):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(body % i)
    dirs = {m: str(tmp_path / m) for m in ("base", "sft", "dpo")} | {"all": str(tmp_path)}
    found = results.scan_results(spark, dirs)
    assert str(found._jdf.queryExecution().executedPlan()).count("Scan text") == 1
    got = sorted((r.model, r.body) for r in found.collect())
    assert got == sorted([("base", body % 0), ("sft", body % 1), ("dpo", body % 2), *[("all", body % i) for i in range(3)]])
