import pytest
from pyspark.sql import functions as F

from turnwise.operators import chat, turns

MESSAGES = "row_id bigint, messages array<struct<role:string,content:string>>"
TURNS = "conv_id bigint, turn bigint, role string, text string"
TABLE = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"),
    (2, 0, "user", "only"),
    (3, 0, "assistant", "first"), (3, 1, "user", "x"),
]


def test_rendering(spark):
    df = spark.createDataFrame([(1, [("user", "u"), ("assistant", "a")]), (2, [])], MESSAGES)
    got = [r[0] for r in df.orderBy("row_id").select(chat.render_messages(F.col("messages"))).collect()]
    assert got == ["<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n", ""]
    asked = chat.render_messages(chat.prompt_messages(F.col("messages")), add_generation_prompt=True)
    got = [r[0] for r in df.orderBy("row_id").select(asked).collect()]
    assert got == ["<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n", "<|im_start|>assistant\n"]
    plain = chat.ChatTemplate("[", "]", ".")
    assert df.filter("row_id = 1").select(chat.render_messages(F.col("messages"), plain)).first()[0] == "[user]u.[assistant]a."


def test_prompt_part_of_a_list(spark):
    df = spark.createDataFrame(
        [
            (1, [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v")]),
            (2, [("user", "u")]),
            (3, [("assistant", "a"), ("user", "u")]),
        ],
        MESSAGES,
    )
    got = df.orderBy("row_id").select(chat.prompt_messages(F.col("messages")).alias("p")).collect()
    assert [[m.content for m in r.p] for r in got] == [["s", "u"], ["u"], []]


def test_turns_to_lists(spark):
    df = spark.createDataFrame(TABLE, TURNS).repartition(5)
    got = turns.messages_from_turns(df).orderBy("conv_id").collect()
    assert [[m.content for m in r.messages] for r in got] == [["s", "u", "a", "v", "b"], ["only"], ["first", "x"]]
    assert {(r.part, r.n_parts) for r in got} == {(0, 1)}


@pytest.mark.parametrize("first", [0, 1022, 1_700_000_000_000])
@pytest.mark.parametrize("step", [1, 1000])
def test_a_long_conversation_becomes_parts_by_position(spark, first, step):
    long = spark.range(2500).selectExpr("9L conv_id", f"{first} + id * {step} turn", "'user' role", "cast(id as string) text")
    df = long.union(spark.createDataFrame(TABLE, TURNS)).repartition(3)
    got = turns.messages_from_turns(df, part_size=1000).orderBy("conv_id", "part").collect()
    assert [(len(r.messages), r.n_parts) for r in got] == [(5, 1), (1, 1), (2, 1), (1000, 3), (1000, 3), (500, 3)]
    assert [m.content for r in got if r.conv_id == 9 for m in r.messages] == [str(i) for i in range(2500)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_turns_keep_their_order_and_none_is_lost(spark, partitions):
    rows = [(7, k % 3, "user", f"{k % 5}") for k in range(900)] + [(7, None, "user", "unnumbered")] + TABLE
    df = spark.createDataFrame(rows, TURNS).repartition(partitions)
    got = turns.messages_from_turns(df, part_size=100).orderBy("conv_id", "part").collect()
    hot = [r for r in got if r.conv_id == 7]
    assert [len(r.messages) for r in hot] == [100] * 9 + [1] and {r.n_parts for r in hot} == {10}
    want = ["unnumbered"] + [t for _, t in sorted((k % 3, f"{k % 5}") for k in range(900))]
    assert [m.content for r in hot for m in r.messages] == want
    assert sorted(len(r.messages) for r in got if r.conv_id != 7) == [1, 2, 5]


def test_part_size_does_not_change_the_messages(spark):
    rows = TABLE + [(None, k, "user", str(k)) for k in range(7)] + [(4, 1_700_000_000_000 + 900 * k, "user", str(k)) for k in range(6)]
    df = spark.createDataFrame(rows, TURNS)
    whole = {r.conv_id: [m.content for m in r.messages] for r in turns.messages_from_turns(df).collect()}
    assert len(whole) == 5 and whole[4] == [str(k) for k in range(6)]
    for size in (1, 2, 4):
        parts = turns.messages_from_turns(df, part_size=size).orderBy("part").collect()
        again = {c: [m.content for r in parts if r.conv_id == c for m in r.messages] for c in whole}
        assert again == whole


def test_exchanges(spark):
    got = turns.exchanges(spark.createDataFrame(TABLE, TURNS)).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == [(1, 1, "u", "a", "s"), (1, 3, "v", "b", "s")]


def test_rendered_turns_join_to_the_chat_text(spark):
    df = spark.createDataFrame(TABLE, TURNS)
    pieces = turns.rendered_turns(df).filter("conv_id = 1").orderBy("turn").collect()
    whole = turns.messages_from_turns(df).filter("conv_id = 1").select(chat.render_messages(F.col("messages"))).first()[0]
    assert "".join(p.rendered for p in pieces) == whole


def test_prompt_turns(spark):
    rows = TABLE + [(4, None, "user", "no number"), (4, 2, "user", "two"), (None, 1, "user", "nobody"), (5, None, "assistant", "a")]
    got = turns.prompt_turns(spark.createDataFrame(rows, TURNS)).collect()
    want = [(None, "nobody"), (1, "s"), (1, "u"), (2, "only"), (4, "no number"), (4, "two")]
    assert sorted(((r.conv_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_first_answered(spark):
    df = spark.createDataFrame(TABLE, TURNS).repartition(4)
    got = {r.conv_id: r for r in turns.first_answered(df).collect()}
    assert (got[1].asked, got[1].system, got[1].answered, got[1].answered_last, got[1].n_answers) == ("u", "s", "a", "b", 2)
    assert (got[2].system, got[2].answered, got[2].n_answers) == ("", None, 0)
