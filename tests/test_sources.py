import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import types as T

from turnwise.plans import readiness
from turnwise.sources import corpora, files, inventory, json_array, saved
from turnwise.sources.registry import INSTRUCTION_SPLITS, PREFERENCE_SPLITS, instruction_spec, preference_spec

ALPACA = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")])


def save_split(folder, tables, batch_rows=3):
    folder.mkdir(parents=True)
    names = []
    for i, table in enumerate(tables):
        name = f"data-{i:05d}-of-{len(tables):05d}.arrow"
        with pa.ipc.new_stream(str(folder / name), table.schema) as writer:
            writer.write_table(table, max_chunksize=batch_rows)
        names.append({"filename": name})
    (folder / "state.json").write_text(json.dumps({"_data_files": names}))
    (folder / "dataset_info.json").write_text("{}")


def prompts(lo, hi):
    ids = list(range(lo, hi))
    turn = [[{"role": "user", "content": f"p{i}"}, {"role": "assistant", "content": f"a{i}"}] for i in ids]
    return pa.table({"prompt": [f"p{i}" for i in ids], "chosen": turn, "rejected": turn})


def test_saved_splits(spark, tmp_path):
    root = tmp_path / "ultrafeedback"
    for name, lo in (("test", 900), ("train_prefs", 0), ("train", 500)):
        save_split(root / name, [prompts(lo, lo + 10), prompts(lo + 10, lo + 17)])
    (root / "dataset_dict.json").write_text(json.dumps({"splits": ["test", "train_prefs", "train"]}))
    path = str(root)
    assert corpora.detect_layout(spark, path) is corpora.Layout.SPLITS
    preferred = saved.load_saved(spark, path, PREFERENCE_SPLITS)
    assert sorted(r.prompt for r in preferred.collect()) == sorted(f"p{i}" for i in range(17))
    assert preferred.first().chosen[1].content.startswith("a")
    instruction = saved.load_saved(spark, path, INSTRUCTION_SPLITS)
    assert {r.prompt for r in instruction.collect()} == {f"p{i}" for i in range(500, 517)}
    assert saved.load_all_splits(spark, path).groupBy("split").count().count() == 3
    read = corpora.read_preference_corpus(spark, preference_spec("ultrafeedback"), [str(tmp_path)])
    assert read.count() == 17


def test_row_ids_follow_shard_and_place(spark, tmp_path):
    save_split(tmp_path / "a folder" / "d", [prompts(0, 10), prompts(10, 17)])
    for slice_bytes in (1 << 20, 200):  # the second setting cuts each shard into several partitions
        df = saved.read_saved_split(spark, str(tmp_path / "a folder" / "d"), slice_bytes)
        assert (df.rdd.getNumPartitions() > 2) == (slice_bytes == 200)
        rows = df.orderBy("row_id").collect()
        assert [r.prompt for r in rows] == [f"p{i}" for i in range(17)]
        assert rows[9].row_id == 9 and rows[10].row_id == saved.SHARD_ROWS


def test_choice_of_split():
    assert saved.choose_split(["test", "train_prefs", "train"], PREFERENCE_SPLITS) == "train_prefs"
    assert saved.choose_split(["test", "train_prefs", "train"], INSTRUCTION_SPLITS) == "train"
    assert saved.choose_split(["x", "train"], PREFERENCE_SPLITS) == "train"
    assert saved.choose_split(["b", "a"], PREFERENCE_SPLITS) == "b"


def test_layouts(spark, tmp_path):
    def layout(*names):
        folder = tmp_path / f"f{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for n in names:
            (folder / n).touch()
        return corpora.detect_layout(spark, str(folder))

    assert layout("state.json", "dataset_info.json", "dataset_dict.json", "train") is corpora.Layout.SPLITS
    assert layout("state.json", "dataset_info.json", "train") is corpora.Layout.SAVED
    assert layout("state.json", "train", "alpaca_data.json") is corpora.Layout.TRAIN_FOLDER
    assert layout("state.json", "alpaca_data.json") is corpora.Layout.STATE
    assert layout("alpaca_data.json", "x") is corpora.Layout.JSON_ARRAY
    assert layout("what.bin") is corpora.Layout.OTHER


def test_train_folder_without_a_split_list(spark, tmp_path):
    save_split(tmp_path / "alpaca" / "train", [prompts(0, 4)])
    assert corpora.read_instruction_corpus(spark, instruction_spec("alpaca"), [str(tmp_path)]).count() == 4


def test_unknown_format_lists_the_contents(spark, tmp_path):
    (tmp_path / "alpaca").mkdir()
    (tmp_path / "alpaca" / "what.bin").touch()
    with pytest.raises(ValueError, match="what.bin"):
        corpora.read_instruction_corpus(spark, instruction_spec("alpaca"), [str(tmp_path)])


def test_first_existing_root_wins(spark, tmp_path):
    spec = instruction_spec("alpaca")
    (tmp_path / "b" / "alpaca").mkdir(parents=True)
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert corpora.resolve_source(spark, spec, roots).endswith("b/alpaca")
    with pytest.raises(FileNotFoundError, match="tatsu-lab/alpaca"):
        corpora.resolve_source(spark, spec, roots[:1])


def test_first_available(spark, tmp_path):
    def broken():
        return spark.read.parquet(str(tmp_path / "absent"))

    good = lambda: spark.range(3)
    name, df = corpora.read_first_available([("hub", broken), ("range", good)], ["id"])
    assert name == "range" and df.count() == 3
    with pytest.raises(ValueError, match="lacks"):
        corpora.read_first_available([("hub", broken), ("range", good)], ["text"])


TRICKY = ['x"}, {"instruction": "y', "}, {", 'ends with }, {', "été \n \\", '[{"instruction":', "}]"]


@pytest.mark.parametrize("layout", [dict(indent=4), dict(), dict(separators=(",", ":")), dict(indent=2, ensure_ascii=False)])
def test_json_array_cut_into_splits(spark, tmp_path, layout):
    rows = [{"instruction": f"{i} {TRICKY[i % 6]}", "input": TRICKY[(i // 6) % 6], "output": "o" * (i % 50)} for i in range(3000)]
    path = tmp_path / "alpaca_data.json"
    path.write_text(json.dumps(rows, **layout), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        cut = json_array.read_json_array(spark, str(path), ALPACA)
        assert cut.rdd.getNumPartitions() > 3
        got = [r.asDict() for r in cut.orderBy("row_id").collect()]
        assert got == [{"row_id": i, **r} for i, r in enumerate(rows)]
        spark.conf.set("spark.sql.files.maxPartitionNum", "3")  # several splits in a partition
        packed = json_array.read_json_array(spark, str(path), ALPACA)
        assert [r.asDict() for r in packed.orderBy("row_id").collect()] == got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.maxPartitionNum")


PARTS = st.sampled_from(['"', "\\", "}", "{", ",", ":", "[", "]", " ", "\n", "instruction", "é", '}, {"instruction":', "a"])
WORDS = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(WORDS, WORDS, WORDS), min_size=2, max_size=30),
    st.sampled_from([dict(indent=4), dict(), dict(separators=(",", ":")), dict(indent=0)]),
    st.integers(60, 400),
)
def test_any_strings_survive_the_cut(spark, tmp_path, objects, layout, split):
    rows = [dict(zip(("instruction", "input", "output"), o)) for o in objects]
    path = tmp_path / "any.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, **layout), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = json_array.read_json_array(spark, str(path), ALPACA).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.asDict() for r in got] == [{"row_id": i, **r} for i, r in enumerate(rows)]


def test_json_array_of_uneven_layout(spark, tmp_path):
    """Objects the separator does not cut come along in the piece of their neighbour."""
    a, b = '{"instruction": "%d", "input": "", "output": "o"}', ",\n\n"
    text = "[ " + a % 0 + ", " + a % 1 + b + a % 2 + " , " + a % 3 + ", " + a % 4 + " ]\n"
    (tmp_path / "alpaca_data.json").write_text(text)
    df = json_array.read_json_array(spark, str(tmp_path / "alpaca_data.json"), ALPACA)
    assert [(r.row_id, r.instruction) for r in df.orderBy("row_id").collect()] == [(i, str(i)) for i in range(5)]
    (tmp_path / "alpaca_data.json").write_text("[]")
    assert json_array.read_json_array(spark, str(tmp_path / "alpaca_data.json"), ALPACA).count() == 0


def test_json_array_with_other_columns_first_and_white_space_before(spark, tmp_path):
    rows = [{"id": i, "instruction": str(i), "input": "", "output": "o"} for i in range(50)]
    (tmp_path / "alpaca_data.json").write_text("\n\t " + json.dumps(rows))
    df = json_array.read_json_array(spark, str(tmp_path / "alpaca_data.json"), ALPACA)
    assert [(r.row_id, r.instruction) for r in df.orderBy("row_id").collect()] == [(i, str(i)) for i in range(50)]


def test_json_array_of_large_objects_and_keys_in_any_order(spark, tmp_path):
    keys = ["instruction", "input", "output"]
    rows = [{k: f"{k} {i} }}{{" for k in keys[i % 3 :] + keys[: i % 3]} | {"more": [{"a": {"b": "}"}}, 3]} for i in range(400)]
    rows[0]["output"] = "x{}" * 70_000  # longer than several splits
    path = tmp_path / "alpaca_data.json"
    path.write_text(json.dumps(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        df = json_array.read_json_array(spark, str(path), ALPACA)
        assert df.rdd.getNumPartitions() > 6
        got = [r.asDict() for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [{"row_id": i} | {k: r[k] for k in keys} for i, r in enumerate(rows)]


@pytest.mark.parametrize("end", ['{"instruction": "a"', '{"instruction": "a"}', '{"instruction": "a}]', '{"instruction": {"a": "b"}]'])
def test_json_array_that_is_cut_short(spark, tmp_path, end):
    (tmp_path / "alpaca_data.json").write_text('[{"instruction": "a", "input": "", "output": ""}, ' + end)
    with pytest.raises(Exception, match="ends inside|MALFORMED"):
        json_array.read_json_array(spark, str(tmp_path / "alpaca_data.json"), ALPACA).collect()


def test_saved_split_written_and_read_back(spark, tmp_path):
    df = spark.range(0, 5000, 1, 5).selectExpr("id", "repeat(cast(id as string), 9) text", "array(id, null) list", "if(id % 3 = 0, null, 'x') some")
    saved.write_saved({"test": df.filter("id < 10"), "train": df}, str(tmp_path / "set"))
    got = saved.load_saved(spark, str(tmp_path / "set"), ["train"])
    assert sorted(map(tuple, got.drop("row_id").collect())) == sorted(map(tuple, df.collect()))
    assert got.select("row_id").distinct().count() == 5000
    one = saved.load_saved(spark, str(tmp_path / "set"), ["train"], ["text"])
    assert one.columns == ["row_id", "text"] and one.agg({"text": "max"}).first()[0] == "9" * 27
    plan = one.select("text")._jdf.queryExecution().executedPlan().toString()
    assert "some" not in plan and "list" not in plan
    assert saved.write_saved_split(df, str(tmp_path / "small"), batch_rows=100) == 5000
    small = saved.read_saved_split(spark, str(tmp_path / "small"), slice_bytes=20_000)
    assert small.rdd.getNumPartitions() >= 10
    assert sorted(r.row_id for r in small.collect()) == sorted(r.row_id for r in got.collect())
    saved.write_saved_split(df.limit(0), str(tmp_path / "none"))
    assert saved.read_saved_split(spark, str(tmp_path / "none")).count() == 0


def test_parquet_without_ids_is_numbered_by_place(spark, tmp_path):
    rows = spark.range(0, 100, 1, 3).selectExpr("cast(id as string) instruction", "'' input", "'o' output")
    rows.write.parquet(str(tmp_path / "alpaca"))
    df = corpora.read_instruction_corpus(spark, instruction_spec("alpaca"), [str(tmp_path)])
    first = {r.row_id: r.instruction for r in df.collect()}
    again = {r.row_id: r.instruction for r in df.repartition(7).collect()}
    assert len(first) == 100 and first == again


def test_json_corpus_folder(spark, tmp_path):
    (tmp_path / "alpaca").mkdir()
    (tmp_path / "alpaca" / "alpaca_data.json").write_text(json.dumps([{"instruction": "i", "input": "", "output": "o"}]))
    df = corpora.read_instruction_corpus(spark, instruction_spec("alpaca"), [str(tmp_path)])
    assert df.columns == ["row_id", "instruction", "input", "output"] and df.count() == 1


def test_listing_sees_hidden_names(spark, tmp_path):
    (tmp_path / "_x" / ".y").mkdir(parents=True)
    (tmp_path / "_x" / ".y" / "f.txt").write_text("abc")
    found = files.walk(spark, str(tmp_path))
    assert [(f.name, f.length) for f in found] == [("f.txt", 3)]
    assert files.read_head(spark, str(tmp_path / "_x" / ".y" / "f.txt"), 2) == b"ab"


def test_inventory(spark, tmp_path):
    (tmp_path / "a" / "__deep [a]?").mkdir(parents=True)
    (tmp_path / "a" / "one.bin").write_bytes(b"x" * 1500)
    (tmp_path / "a" / "__deep [a]?" / "two.bin").write_bytes(b"x" * 200)
    (tmp_path / "a" / "__deep [a]?" / ".lock").write_bytes(b"x" * 100)
    (tmp_path / "a" / "_SUCCESS").write_bytes(b"x" * 100)
    (tmp_path / "a" / "_metadata").write_bytes(b"x" * 100)
    folders = {"a": str(tmp_path / "a"), "gone": str(tmp_path / "gone")}
    got = {r.corpus: (r.n_files, r.megabytes, r.passed) for r in inventory.corpus_sizes(spark, folders).collect()}
    assert got == {"a": (5, 0.002, True), "gone": (0, 0.0, False)}
    assert not readiness.ready(spark, folders, {}).first().all_passed
    del folders["gone"]
    assert readiness.ready(spark, folders, {"t": spark.range(1)}).first().all_passed
    assert not readiness.ready(spark, folders, {"t": spark.range(0)}).first().all_passed
