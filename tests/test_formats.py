import pytest
from pyspark.errors import PySparkException

from turnwise.operators import formats
from turnwise.sources.registry import INSTRUCTION_CORPORA, PREFERENCE_CORPORA, instruction_spec, preference_spec

ALPACA = "row_id bigint, instruction string, input string, output string"
MESSAGES = "array<struct<role:string,content:string>>"


def rows(df):
    return [tuple(r) for r in df.orderBy("row_id").collect()]


def pairs(messages):
    return [(m.role, m.content) for m in messages]


def test_registry():
    assert list(INSTRUCTION_CORPORA) == ["alpaca", "sharegpt", "openorca"]
    assert list(PREFERENCE_CORPORA) == ["ultrafeedback", "helpsteer", "anthropic_hh"]
    assert preference_spec("ultrafeedback").split == "train_prefs"
    with pytest.raises(ValueError, match="alpaca.*sharegpt.*openorca"):
        instruction_spec("nope")
    with pytest.raises(ValueError):
        preference_spec("alpaca")


def test_alpaca_input_is_optional(spark):
    df = spark.createDataFrame([(1, "q", None, "a"), (2, "q", "", "a"), (3, "q", " ", "a"), (4, "q", "x", "a")], ALPACA)
    got = rows(formats.alpaca_messages(df, instruction_spec("alpaca")))
    assert [pairs(m)[0][1] for _, m in got] == ["q", "q", "q\n\n ", "q\n\nx"]
    assert all(pairs(m)[1] == ("assistant", "a") for _, m in got)
    without = formats.alpaca_messages(df.drop("input"), instruction_spec("alpaca"))
    assert {pairs(m)[0][1] for _, m in rows(without)} == {"q"}
    assert without.columns == ["row_id", "messages"]


def test_sharegpt_senders(spark):
    turns = [("system", "s"), ("human", "h"), ("gpt", "g"), ("tool", "t")]
    df = spark.createDataFrame(
        [(1, turns), (2, [])], "row_id bigint, conversations array<struct<from:string,value:string>>"
    )
    got = rows(formats.sharegpt_messages(df, instruction_spec("sharegpt")))
    assert pairs(got[0][1]) == [("assistant", "s"), ("user", "h"), ("assistant", "g"), ("assistant", "t")]
    assert got[1][1] == []


def test_openorca_system_is_optional(spark):
    df = spark.createDataFrame(
        [(1, "s", "q", "r"), (2, "", "q", "r"), (3, None, "q", "r")],
        "row_id bigint, system_prompt string, question string, response string",
    )
    got = rows(formats.format_corpus(df, instruction_spec("openorca")))
    assert pairs(got[0][1]) == [("system", "s"), ("user", "q"), ("assistant", "r")]
    assert [len(m) for _, m in got] == [3, 2, 2]


def test_ultrafeedback_takes_the_last_messages(spark):
    schema = f"row_id bigint, prompt string, chosen {MESSAGES}, rejected {MESSAGES}"
    good = (1, "p", [("user", "p"), ("assistant", "c")], [("assistant", "r1"), ("assistant", "r2")])
    empty = (2, "p", [], [("assistant", "r")])
    spec = preference_spec("ultrafeedback")
    assert rows(formats.format_corpus(spark.createDataFrame([good], schema), spec)) == [(1, "p", "c", "r2")]
    both = spark.createDataFrame([good, empty], schema)
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(PySparkException, match="without chosen messages"):
            formats.ultrafeedback_triples(both, spec).collect()
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert rows(formats.ultrafeedback_triples(both, spec, strict=False))[1] == (2, "p", None, "r")
    assert [r.row_id for r in formats.usable_rows(both, spec).collect()] == [1]
    assert [r.row_id for r in formats.quarantined_rows(both, spec).collect()] == [2]


def test_transcripts_and_pass_through(spark):
    df = spark.createDataFrame([(1, "full c", "full r")], "row_id bigint, chosen string, rejected string")
    assert rows(formats.format_corpus(df, preference_spec("anthropic_hh"))) == [(1, "", "full c", "full r")]
    assert formats.format_corpus(df, preference_spec("helpsteer")).columns == df.columns


def test_quarantine_is_the_complement(spark):
    df = spark.createDataFrame([(1, "q", None, "a"), (2, None, "x", "a"), (3, "q", "x", None)], ALPACA)
    spec = instruction_spec("alpaca")
    assert [r.row_id for r in formats.usable_rows(df, spec).collect()] == [1]
    assert sorted(r.row_id for r in formats.quarantined_rows(df, spec).collect()) == [2, 3]


def test_messages_without_text_are_quarantined(spark):
    df = spark.createDataFrame(
        [(1, [("human", "h")]), (2, [("human", "h"), ("gpt", None)]), (3, None), (4, [(None, "x")])],
        "row_id bigint, conversations array<struct<from:string,value:string>>",
    )
    spec = instruction_spec("sharegpt")
    assert sorted(r.row_id for r in formats.usable_rows(df, spec).collect()) == [1, 4]
    assert sorted(r.row_id for r in formats.quarantined_rows(df, spec).collect()) == [2, 3]


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "alpaca")
    spark.createDataFrame([(1, "q", "i", "a", "unused")], ALPACA + ", extra string").write.parquet(path)
    df = formats.format_corpus(spark.read.parquet(path), instruction_spec("alpaca"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan and "Exchange" not in plan
