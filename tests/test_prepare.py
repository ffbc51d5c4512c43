import json
import math

import pytest
from pyspark.sql import functions as F

from turnwise.operators import formats, labels, splits, tokens
from turnwise.plans import prepare
from turnwise.sources.registry import instruction_spec
from turnwise.streaming.follow import prepare_arrivals
from test_sources import prompts, save_split

BYTES = tokens.ByteEncoder()


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "raw" / "alpaca").mkdir(parents=True)
    rows = [{"instruction": f"say {i}", "input": "x" * i if i % 2 else "", "output": "y"} for i in range(100)]
    rows.append({"instruction": None, "input": "x", "output": "y"})
    (tmp_path / "raw" / "alpaca" / "alpaca_data.json").write_text(json.dumps(rows))
    save_split(tmp_path / "raw" / "ultrafeedback", [prompts(0, 30)])
    return [str(tmp_path / "raw")]


def test_unknown_corpus_is_refused_first(spark):
    with pytest.raises(ValueError, match="no corpus is registered"):
        prepare.load_instruction_corpus(spark, "nope", BYTES)
    with pytest.raises(ValueError):
        prepare.PrepareOptions(on_overflow="wrap")


def test_prepare_instruction_corpus(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    options = prepare.PrepareOptions(max_seq_length=120, validation_size=0.05)
    rows, stats = prepare.prepare_instruction_corpus(spark, "alpaca", BYTES, out, options, raw)
    assert rows.count() == 100 and set(rows.columns) == {
        "row_id", "messages", "input_ids", "attention_mask", "labels", "split"
    }
    got = {r.split: r for r in stats.collect()}
    assert got["validation"].n_rows == 5 and got["train"].n_rows == 95 and got["train"].max_tokens == 120
    assert (tmp_path / "out" / "alpaca_sft" / "split=train").is_dir()
    # a second run reads what is there, even when the source is gone
    again, _ = prepare.prepare_instruction_corpus(spark, "alpaca", BYTES, out, options, ["/nowhere"])
    assert again.count() == 100
    assert prepare.rejected_rows(spark, "alpaca", raw).count() == 1


def test_overflow_drop(spark, raw, tmp_path):
    keep = prepare.PrepareOptions(max_seq_length=120)
    drop = prepare.PrepareOptions(max_seq_length=120, on_overflow="drop")
    kept = prepare.load_instruction_corpus(spark, "alpaca", BYTES, keep, raw)
    dropped, _ = prepare.prepare_instruction_corpus(spark, "alpaca", BYTES, str(tmp_path / "out"), drop, raw)
    whole = prepare.load_instruction_corpus(spark, "alpaca", BYTES, prepare.PrepareOptions(), raw)
    short = {r.row_id for r in whole.filter(F.size("input_ids") <= 120).collect()}
    assert kept.count() == 100 and 0 < len(short) < 100
    assert {r.row_id for r in dropped.collect()} == short
    assert dropped.filter("split = 'validation'").count() == math.ceil(len(short) * 0.02)


def test_intermediate_tables_are_never_stale(spark, raw, tmp_path):
    import shutil

    out = str(tmp_path / "out")
    for limit in (120, 90):
        options = prepare.PrepareOptions(max_seq_length=limit, on_overflow="drop")
        _, stats = prepare.prepare_instruction_corpus(spark, "alpaca", BYTES, out, options, raw)
        assert 85 < max(r.max_tokens for r in stats.collect()) <= limit
        shutil.rmtree(f"{out}/alpaca_sft")


def test_other_options_build_the_table_again(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    for limit in (120, 16, 16):
        options = prepare.PrepareOptions(max_seq_length=limit)
        _, stats = prepare.prepare_instruction_corpus(spark, "alpaca", BYTES, out, options, raw)
        assert max(r.max_tokens for r in stats.collect()) == limit
    lost = prepare.losses(spark, "alpaca", BYTES, prepare.PrepareOptions(max_seq_length=120), raw).first()
    whole = prepare.load_instruction_corpus(spark, "alpaca", BYTES, prepare.PrepareOptions(), raw)
    assert (lost.n_rows, lost.n_rejected) == (101, 1)
    assert lost.n_overlong == whole.filter(F.size("input_ids") > 120).count() > 0


def test_preference_rows_without_an_answer(spark, tmp_path):
    import pyarrow as pa

    said = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    table = pa.table({"prompt": ["p", "p"], "chosen": pa.array([said, []], pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))), "rejected": [said, said]})
    save_split(tmp_path / "ultrafeedback", [table])
    roots = [str(tmp_path)]
    with pytest.raises(Exception, match="lacks a required field"):
        prepare.load_preference_corpus(spark, "ultrafeedback", roots).collect()
    assert prepare.load_preference_corpus(spark, "ultrafeedback", roots, strict=False).count() == 1
    assert prepare.rejected_rows(spark, "ultrafeedback", roots).count() == 1
    lost = prepare.losses(spark, "ultrafeedback", roots=roots).first()
    assert (lost.n_rows, lost.n_rejected, lost.n_overlong) == (2, 1, 0)


def test_preference_path(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    rows, total = prepare.prepare_preference_corpus(spark, "ultrafeedback", out, raw)
    assert total.first().n_rows == 30 and rows.columns == ["row_id", "prompt", "chosen", "rejected"]
    assert rows.filter("row_id = 3").first().chosen == "a3"
    split = prepare.preference_training_rows(spark, "ultrafeedback", out, raw)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 29, "validation": 1}


def test_skip_existing_and_incomplete_targets(spark, tmp_path):
    path = str(tmp_path / "t")
    prepare.write_prepared(spark.range(3), path)
    prepare.write_prepared(spark.range(9), path, skip_existing=True)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="not written to the end"):
        prepare.read_or_build(spark, str(tmp_path / "half"), lambda: spark.range(1))
    assert prepare.read_or_build(spark, str(tmp_path / "new"), lambda: spark.range(4)).count() == 4


def test_even_files(spark, tmp_path):
    df = splits.exact_split(spark.range(0, 1000, 1, 40).withColumnRenamed("id", "row_id"))
    prepare.write_prepared(df, str(tmp_path / "scattered"))
    prepare.write_prepared(df, str(tmp_path / "even"), even_files=True)
    files = {n: len(list((tmp_path / n).rglob("*.parquet"))) for n in ("scattered", "even")}
    assert files["even"] == 2 < files["scattered"]
    assert spark.read.parquet(str(tmp_path / "even")).count() == 1000


def test_reading_one_split_prunes_the_others(spark, tmp_path):
    from turnwise.sources.corpora import read_instruction_corpus

    df = splits.exact_split(spark.range(100).selectExpr("id row_id", "'i' instruction", "'' input", "'o' output"))
    prepare.write_prepared(df, str(tmp_path / "alpaca"))
    got = read_instruction_corpus(spark, instruction_spec("alpaca"), [str(tmp_path)])
    assert got.count() == 98 and "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString()


def test_stream_gives_the_batch_answer(spark, tmp_path):
    spec = instruction_spec("alpaca")

    def transform(df):
        rows = labels.completion_examples(formats.format_corpus(df, spec), BYTES, 100)
        return splits.hash_split(rows, test_size=0.2)

    source = str(tmp_path / "in")
    df = spark.range(0, 60, 1, 3).selectExpr("id row_id", "concat('q', id) instruction", "'' input", "repeat('o', int(id)) output")
    df.limit(30).write.parquet(source)
    paths = [str(tmp_path / "out"), str(tmp_path / "checkpoint")]
    prepare_arrivals(spark, source, df.schema, transform, *paths)
    assert spark.read.parquet(paths[0]).count() == 30
    df.filter("row_id >= 1000").union(df.subtract(df.limit(30))).write.mode("append").parquet(source)
    prepare_arrivals(spark, source, df.schema, transform, *paths)
    streamed = {(r.row_id, r.split, tuple(r.labels)) for r in spark.read.parquet(paths[0]).collect()}
    batch = {(r.row_id, r.split, tuple(r.labels)) for r in transform(spark.read.parquet(source)).collect()}
    assert streamed == batch and len(streamed) == 60


def test_every_registered_corpus_from_saved_shards(spark, tmp_path):
    import pyarrow as pa

    turns = [[{"from": "system", "value": "s"}, {"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]] * 4
    save_split(tmp_path / "sharegpt" / "train", [pa.table({"id": ["x"] * 4, "conversations": turns})])
    (tmp_path / "sharegpt" / "dataset_dict.json").write_text('{"splits": ["train"]}')
    orca = {"id": ["1", "2"], "system_prompt": ["", "s"], "question": ["q", "q"], "response": ["r", "r"]}
    save_split(tmp_path / "openorca", [pa.table(orca)])
    save_split(tmp_path / "anthropic_hh", [pa.table({"chosen": ["c"], "rejected": ["r"]})])
    save_split(tmp_path / "helpsteer", [pa.table({"prompt": ["p"], "helpfulness": [3]})])
    roots = [str(tmp_path)]

    def texts(name):
        rows = prepare.load_instruction_corpus(spark, name, BYTES, roots=roots)
        return sorted(bytes(r.input_ids).decode() for r in rows.collect())

    assert texts("sharegpt") == [
        "<|im_start|>assistant\ns<|im_end|>\n<|im_start|>user\nh<|im_end|>\n<|im_start|>assistant\ng<|im_end|>\n"
    ] * 4
    pair = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    assert texts("openorca") == ["<|im_start|>system\ns<|im_end|>\n" + pair, pair]
    hh = prepare.load_preference_corpus(spark, "anthropic_hh", roots).first()
    assert (hh.prompt, hh.chosen, hh.rejected) == ("", "c", "r")
    steer = prepare.load_preference_corpus(spark, "helpsteer", roots).first()
    assert (steer.prompt, steer.helpfulness) == ("p", 3)
