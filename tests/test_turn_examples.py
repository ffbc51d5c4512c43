import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import labels, tokens, turn_examples, turns
from vocabulary_document import _tokenizer_document

TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant"], ["user"], ["assistant", "user"]])
        for t in range(rng.randint(1, 9)):
            text = "".join(rng.choice("ab é<|>\n ,_") for _ in range(rng.randint(0, 25)))
            rows.append((c, 3 * t + rng.randint(0, 2), roles[t % len(roles)], text))
    rng.shuffle(rows)
    return rows


def byte_pair_document():
    """A small byte-level BPE tokenizer with the chat markers as special tokens."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(vocab_size=400, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    tokenizer.train_from_iterator([text for *_, text in conversations(0, 200)] + ["user\nassistant\n"] * 50, trainer)
    tokenizer.add_special_tokens([AddedToken(m, special=True) for m in ("<|im_start|>", "<|im_end|>")])
    return tokenizer.to_str()


ENCODERS = [
    tokens.ByteEncoder(),
    tokens.RegexEncoder(["<|im_start|>", "<|im_end|>", "user", "a", ","]),
    tokens.TokenizerFileEncoder(_tokenizer_document(["<|im_start|>", "user", "b"])),
    tokens.TokenizerFileEncoder(byte_pair_document()),
]


@pytest.mark.parametrize("encoder", ENCODERS, ids=["bytes", "regex", "words", "byte pairs"])
@pytest.mark.parametrize("limit", [1, 30, 4096])
def test_same_rows_as_whole_conversations(spark, encoder, limit):
    df = spark.createDataFrame(conversations(limit), TURNS).repartition(6)
    whole = turns.messages_from_turns(df).select("conv_id", "messages")
    for only in (True, False):
        fn = labels.completion_examples if only else labels.full_examples
        expected = {r.conv_id: (r.input_ids, r.attention_mask, r.labels) for r in fn(whole, encoder, limit).collect()}
        for large in (2, 100_000):  # with and without slicing
            got = turn_examples.examples_from_turns(df, encoder, limit, completion_only=only, large=large).collect()
            assert {r.conv_id: (r.input_ids, r.attention_mask, r.labels) for r in got} == expected
            assert len(got) == 40


def test_a_hot_conversation_of_copies(spark):
    hot = spark.range(0, 20_000, 1, 8).selectExpr("1L conv_id", "0L turn", "'user' role", "'x' text")
    df = hot.union(spark.createDataFrame([(2, 0, "user", "q"), (2, 1, "assistant", "a")], TURNS))
    got = {r.conv_id: r for r in turn_examples.examples_from_turns(df, tokens.ByteEncoder(), 100, large=1000).collect()}
    assert bytes(got[1].input_ids) == (b"<|im_start|>user\nx<|im_end|>\n" * 4)[:100]
    assert got[1].labels == [-100] * 100
    assert bytes(b for b in got[2].labels if b >= 0) == b"a<|im_end|>\n"


def test_too_many_large_conversations_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(conversations(3), TURNS)
    order = ["turn", "role", "text"]
    expected = turn_examples.leading_turns(df, 3, "conv_id", order)
    monkeypatch.setattr(turn_examples, "MAX_LARGE", 2)
    got = turn_examples.leading_turns(df, 3, "conv_id", order, large=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_only_leading_turns_are_encoded(spark):
    df = spark.range(5000).selectExpr("1L conv_id", "id turn", "'user' role", "cast(id as string) text")
    kept = turn_examples.leading_turns(df, 10, "conv_id", ["turn", "role", "text"], large=100)
    assert sorted(r.turn for r in kept.collect()) == list(range(10))
    assert kept.agg(F.max("place")).first()[0] == 10


def test_byte_pair_ids_against_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    (tmp_path / "tokenizer.json").write_text(byte_pair_document())
    tokenizer = Tokenizer.from_file(str(tmp_path / "tokenizer.json"))
    texts = [text for *_, text in conversations(5)] + ["<|im_start|>user\nab<|im_end|>\n", "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string").repartition(3)
    encoder = tokens.TokenizerFileEncoder.from_file(str(tmp_path / "tokenizer.json"))
    got = {r[0]: r[1] for r in df.select("row_id", encoder.ids(F.col("text"))).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert max(len(v) for v in got.values()) > 3 and tokenizer.token_to_id("<|im_start|>") in got[len(texts) - 2]


def test_encoders_that_join_turns_are_refused(spark):
    from turnwise.operators.chat import ChatTemplate

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    bare = ChatTemplate("", "", "")
    with pytest.raises(ValueError, match="not those of its turns"):
        turn_examples.examples_from_turns(df, tokens.RegexEncoder(()), template=bare)
    assert turn_examples.examples_from_turns(df, tokens.ByteEncoder(), template=bare).count() == 1


def test_marker_ids(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    marks = tokens.SpecialIds(bos=256, eos=257)
    for limit in (20, 4096):
        got = turn_examples.examples_from_turns(df, tokens.ByteEncoder(), limit, special=marks).first()
        lists = turns.messages_from_turns(df).select("conv_id", "messages")
        want = labels.completion_examples(lists, tokens.ByteEncoder(), limit, special=marks).first()
        assert (got.input_ids, got.labels) == (want.input_ids, want.labels)
