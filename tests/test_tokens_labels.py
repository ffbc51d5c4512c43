import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from turnwise.operators import batches, labels, tokens
from vocabulary_document import _tokenizer_document

MESSAGES = "row_id bigint, messages array<struct<role:string,content:string>>"
TEXTS = "row_id bigint, text string"


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_regex_encoder(spark):
    df = spark.createDataFrame([(1, "the cat, the été!"), (2, ""), (3, None)], TEXTS)
    encoder = tokens.RegexEncoder(["the", "cat", ",", "été"])
    got = by_id(df.select("row_id", encoder.ids(F.col("text"))))
    assert got == {1: [0, 1, 2, 0, 3, -1], 2: [], 3: None}
    assert by_id(df.select("row_id", encoder.count(F.col("text")))) == {1: 6, 2: 0, 3: None}
    marked = tokens.RegexEncoder(["<|im_start|>", "user"])
    assert by_id(spark.createDataFrame([(1, "<|im_start|>user\n")], TEXTS).select("row_id", marked.ids(F.col("text")))) == {
        1: [0, 1]
    }


def test_byte_encoder(spark):
    texts = ["aé", "", None, "日本 x"]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS).coalesce(1)
    encoder = tokens.ByteEncoder()
    got = by_id(df.select("row_id", encoder.ids(F.col("text"))))
    assert got == {i: None if t is None else list(t.encode()) for i, t in enumerate(texts)}
    assert by_id(df.select("row_id", encoder.count(F.col("text"))))[3] == 8


def test_three_encoders_agree(spark):
    vocabulary = ["a", "b", "<|im_end|>", "."]
    df = spark.createDataFrame([(1, "a b.a<|im_end|>\nc"), (2, "b  b"), (3, "")], TEXTS)
    native = by_id(df.select("row_id", tokens.RegexEncoder(vocabulary, 4).ids(F.col("text"))))
    filed = tokens.TokenizerFileEncoder(_tokenizer_document(vocabulary))
    assert by_id(df.select("row_id", filed.ids(F.col("text")))) == native
    assert by_id(df.select("row_id", filed.count(F.col("text")))) == {1: 6, 2: 2, 3: 0}
    table = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "token string, id int")
    for head in (0, 2, 100):
        assert by_id(tokens.encode_by_join(df, table, unknown_id=4, head=head)) == native


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "b a a c c c d e e <|im_end|> <|im_end|>"), (2, "c a")], TEXTS)
    got = [(r.token, r.n, r.id) for r in tokens.build_vocabulary(df, 3, reserved=["<|im_end|>"]).orderBy("id").collect()]
    assert got == [("c", 4, 1), ("a", 3, 2), ("e", 2, 3)]
    everything = tokens.build_vocabulary(df, 100, reserved=["<|im_end|>"])
    assert tokens.collect_vocabulary(everything, ["<|im_end|>"]) == ["<|im_end|>", "c", "a", "e", "b", "d"]


def test_vocabulary_too_large_to_ship(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_SHIPPED_TOKENS", 2)
    with pytest.raises(ValueError, match="encode_by_join"):
        tokens.RegexEncoder(["a", "b", "c"])
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 1, 2)], "token string, n bigint, id int")
    with pytest.raises(ValueError, match="encode_by_join"):
        tokens.collect_vocabulary(df)


def test_special_ids_and_truncation(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "a")], TEXTS)
    marks = tokens.SpecialIds(bos=1, eos=2)
    encoder = tokens.ByteEncoder()

    def ids(**kw):
        return by_id(df.select("row_id", tokens.encode(F.col("text"), encoder, **kw)))

    assert ids(max_length=4, special=marks) == {1: [1, 97, 98, 2], 2: [1, 97, 2]}
    assert ids(max_length=4, special=marks, add_special_tokens=False) == {1: [97, 98, 99, 100], 2: [97]}
    assert ids() == {1: [97, 98, 99, 100, 101, 102], 2: [97]}
    assert marks.pad_id == 2 and tokens.SpecialIds(eos=2, pad=5).pad_id == 5
    with pytest.raises(ValueError):
        tokens.SpecialIds().pad_id


def _expected(messages, limit, compat):
    """Brute force over the definition, with one id per byte."""

    def turn(m):
        return f"<|im_start|>{m[0]}\n{m[1]}<|im_end|>\n"

    prompt = []
    for m in messages:
        if m[0] == "assistant":
            break
        prompt.append(m)
    p = len(("".join(map(turn, prompt)) + "<|im_start|>assistant\n").encode())
    ids = list("".join(map(turn, messages)).encode())[:limit]
    if not compat:
        p = min(p, len(ids))
    return ids, [-100] * p + ids[p:]


def test_completion_labels_against_brute_force(spark):
    lists = [
        [("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b")],
        [("system", "s" * 60), ("user", "u" * 50), ("assistant", "a")],
        [("user", "no answer")],
        [("assistant", "a")],
        [],
    ]
    df = spark.createDataFrame(list(enumerate(lists)), MESSAGES)
    for limit in (40, 4096):
        for compat in (False, True):
            got = labels.completion_examples(df, tokens.ByteEncoder(), limit, compat=compat).collect()
            for r in got:
                ids, expected = _expected(lists[r.row_id], limit, compat)
                assert (r.input_ids, r.labels) == (ids, expected)
                assert r.attention_mask == [1] * len(ids)
                assert compat or len(r.labels) == len(r.input_ids)


def test_full_labels(spark):
    df = spark.createDataFrame([(1, [("user", "u"), ("assistant", "a")])], MESSAGES)
    r = labels.full_examples(df, tokens.ByteEncoder(), 10).first()
    assert r.labels == r.input_ids == list(b"<|im_start") and r.attention_mask == [1] * 10
    assert r.messages[0].content == "u"


def test_length_is_cut_not_dropped_at_the_limit(spark):
    from turnwise.operators.filters import overlong_count, within_length

    df = spark.createDataFrame([(1, "abcd"), (2, "abcde")], TEXTS)
    whole = df.select("row_id", tokens.ByteEncoder().ids(F.col("text")).alias("input_ids"))
    cut = df.select("row_id", tokens.encode(F.col("text"), tokens.ByteEncoder(), 4).alias("input_ids"))
    assert within_length(cut, 4).count() == 2
    assert [r.row_id for r in within_length(whole, 4).collect()] == [1]
    assert tuple(overlong_count(whole, 4).first()) == (2, 1)


@pytest.mark.parametrize("side", ["right", "left"])
def test_padded_batches(spark, side):
    rows = [(i, list(range(1, 2 + i % 7))) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>").selectExpr(
        "row_id", "input_ids", "transform(input_ids, x -> 1) attention_mask", "input_ids labels"
    )
    numbered = batches.assign_batches(df, batch_size=8, prefix=1)
    got = batches.pad_batches(numbered, tokens.SpecialIds(eos=99), side).collect()
    assert sorted(r.row_id for r in got) == list(range(50))
    members = {}
    for r in got:
        members.setdefault(r.batch_id, []).append(r)
    assert sorted(len(m) for m in members.values()) == [2, 8, 8, 8, 8, 8, 8]
    for group in members.values():
        assert len({len(r.input_ids) for r in group}) == 1
        assert max(sum(r.attention_mask) for r in group) == len(group[0].input_ids)
    for r in got:
        original = rows[r.row_id][1]
        gap = len(r.input_ids) - len(original)
        front, back = (gap, 0) if side == "left" else (0, gap)
        assert r.input_ids == [99] * front + original + [99] * back
        assert r.labels == [-100] * front + original + [-100] * back
        assert r.attention_mask == [0] * front + [1] * len(original) + [0] * back
    with pytest.raises(ValueError):
        batches.pad_batches(numbered, tokens.SpecialIds(eos=99), "middle")


def test_batch_sizes():
    assert batches.effective_batch(*batches.INSTRUCTION_BATCH) == 128
    assert batches.effective_batch(*batches.PREFERENCE_BATCH) == 128


def test_batches_do_not_depend_on_partitioning(spark):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    one = {tuple(r) for r in batches.assign_batches(df.repartition(1), batch_size=16).collect()}
    many = {tuple(r) for r in batches.assign_batches(df.repartition(11), batch_size=16, prefix=2).collect()}
    assert one == many


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), max_codepoint=0x2FFF), max_size=40), min_size=1, max_size=5))
def test_tokens_cover_the_text(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    got = by_id(df.select("row_id", tokens.RegexEncoder(()).tokens(F.col("text"))))
    for i, t in enumerate(texts):
        assert "".join(got[i]) == re.sub(r"[ \t\n\r\f\x0b]", "", t)
