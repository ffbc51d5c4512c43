"""What the plans must look like for the operators to hold at scale."""

import re

import pytest

from turnwise.operators import batches, labels, scoring, splits, tokens, turn_examples, turns
from turnwise.plans import catalog
from turnwise.session import read_table
from test_queries import FOLDER, pytestmark  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize(
    "name",
    [
        "chat_render", "encode_bytes", "encode_regex", "length_filter", "hash_split", "task_labels", "strict_extract",
        "flexible_extract", "exact_match", "stop_cut", "multiple_choice", "lettered_prompts", "blank_sentences",
        "allowed_tasks", "primary_metric", "gold_index",
    ],
)
def test_row_wise_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(catalog.QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_products_and_no_row_udfs(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in text


def test_only_needed_columns_are_scanned(spark):
    assert scans(plan(catalog.hash_split(spark, FOLDER))) == ["doc_id:bigint"]
    assert set(scans(plan(catalog.accuracy_stderr(spark, FOLDER)))) == {"user_id:bigint,event_type:string,value:double"}
    assert set(scans(plan(tokens.token_counts(read_table(spark, FOLDER, "documents"))))) == {"text:string"}
    assert not any("text" in columns for columns in scans(plan(catalog.vocabulary_topk(spark, FOLDER))))  # counted already
    assert set(scans(plan(catalog.limit_per_task(spark, FOLDER)))) == {"event_id:bigint,event_type:string"}


def test_counting_tokens_stays_in_the_jvm(spark):
    text = plan(catalog.split_stats(spark, FOLDER))
    assert "Python" not in text and text.count("FileScan") == 1


def test_hot_conversations_are_reduced_before_the_shuffle(spark):
    text = plan(turns.first_answered(read_table(spark, FOLDER, "conversations")))
    below = text[text.index("Exchange"):]
    assert "partial_min" in below and "partial_max" in below


def test_limits_are_applied_before_each_shuffle(spark):
    text = plan(scoring.limit_per_task(catalog._predictions(spark, FOLDER), 100))
    assert text.count("WindowGroupLimit") == 4 and text.count("Exchange hashpartitioning") == 2


def test_the_split_moves_no_rows(spark):
    docs = read_table(spark, FOLDER, "documents")
    main = plan(splits.exact_split(docs, "doc_id")).split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


def test_numbering_batches_shuffles_keys_and_broadcasts_bucket_totals_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    labels.full_examples(catalog._alpaca_messages(spark, FOLDER), tokens.ByteEncoder()).write.parquet(path)
    text = plan(batches.assign_batches(spark.read.parquet(path)))
    assert sum("input_ids" in s for s in re.findall(r"ReadSchema: (struct<.*)", text)) == 1
    assert text.count("FileScan") == 3


def test_frequent_tokens_are_kept_out_of_the_vocabulary_shuffle(spark):
    text = plan(catalog.encode_join(spark, FOLDER))
    assert "BroadcastExchange" in text and re.search(r"isnull\(id#\d+\)", text)
    assert "documents.parquet" not in text  # the texts were read once, into blocks of codes


def test_turn_examples_shuffle_the_turns_once(spark):
    df = read_table(spark, FOLDER, "conversations")
    text = plan(turn_examples.examples_from_turns(df, tokens.ByteEncoder(), 128))
    assert text.count("Exchange") == 1 and "hashpartitioning(conv_id" in text
    sliced = plan(turn_examples.examples_from_turns(df, tokens.ByteEncoder(), 128, large=2))
    assert ", slice" in sliced and "LeftSemi" in sliced and "LeftAnti" in sliced
    assert len(re.findall(r" Exchange hashpartitioning\(conv_id#\d+L, \d+\), ENSURE", sliced.split("BroadcastExchange")[0])) == 1


def test_comparing_stages_takes_one_shuffle_after_the_scores(spark):
    text = plan(catalog.metrics.comparison(_metrics_table(spark)))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def _metrics_table(spark):
    return spark.createDataFrame([("base", "t", 0.5)], "model string, task string, value double")
