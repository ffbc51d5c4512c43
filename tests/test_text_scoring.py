import math

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import scoring


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def over(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_labels(spark):
    names = ["arc_challenge", "gsm8k", "commonsense_qa", "it's_ok", "", "été_x"]
    assert over(spark, names, tx.title_label) == [n.replace("_", " ").title() for n in names]
    assert over(spark, names, tx.wrapped_label) == [n.replace("_", "\n") for n in names]


def test_strip_and_lists(spark):
    texts = [" a\t\n", "", "b c", "\u00a0\u2003x\u3000\x1c", " \n ", "a\n b\n\n"]
    assert over(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert over(spark, [" a ,b\t,, c"], tx.comma_list) == [["a", "b", "", "c"]]
    assert over(spark, ["HELLO wORLD", "", "é"], tx.capitalize) == ["Hello world", "", "É"]


def test_cut_always_adds_the_ellipsis(spark):
    assert over(spark, ["abc", "abcdef"], lambda c: tx.cut(c, 4)) == ["abc...", "abcd..."]


def test_numbers_as_text(spark):
    assert over(spark, [1.25001, 0.0, -1.3, None], tx.signed_points, "double") == ["+1.3%", "0.0%", "-1.3%", None]
    assert over(spark, [0.48123, 0.0, None], tx.percent_or_na, "double") == ["48.12", "N/A", "N/A"]
    assert over(spark, [2.031, -0.5], tx.gain_text, "double") == ["+2.03%", "-0.50%"]


def test_rounding_is_that_of_python(spark):
    import random

    rng = random.Random(1)
    values = [0.125, 0.375, 2.675, 0.15, 0.25, -0.25, 1.005, 48.125, 0.0, -0.0, -0.001, 1234.5, 99999.995, 1e-9, 5e15]
    values += [rng.randint(-8000, 8000) / 800 for _ in range(3000)] + [rng.uniform(-100, 100) for _ in range(3000)]
    values += [(rng.randint(0, 800) / 800 - rng.randint(0, 1000) / 1000) * 100 for _ in range(3000)]
    assert over(spark, values, lambda c: tx.fixed(c, 2), "double") == [f"{v:.2f}" for v in values]
    assert over(spark, values, lambda c: tx.fixed(c, 1), "double") == [f"{v:.1f}" for v in values]
    assert over(spark, values, tx.gain_text, "double") == [f"{v:+.2f}%" for v in values]
    signed = [f"+{v:.1f}%" if v > 0 else f"{v:.1f}%" for v in values]
    assert over(spark, values, tx.signed_points, "double") == signed


def test_run_names(spark):
    ts = F.lit("2025-12-31 04:05:06.5").cast("timestamp")
    assert one(spark, tx.run_name(F.lit("m"), ts)) == "m_20251231_040506"
    assert one(spark, tx.run_timestamp(ts)) == "2025-12-31 04:05:06"
    assert one(spark, tx.iso_timestamp(ts)) == "2025-12-31T04:05:06.500000"


def test_answer_extraction(spark):
    texts = ["x #### 1,200.5 y #### 3", "it is $1,200 or 7, so 42.", "none", "-5", "#### -3"]
    assert over(spark, texts, tx.strict_answer) == ["1,200.5", None, None, None, "-3"]
    assert over(spark, texts, tx.flexible_answer) == ["3", "42.", None, "-5", "-3"]


def test_stop_strings(spark):
    texts = ["a Question: b", "a</s>b<|im_end|>", "plain", "", "x<|im_end|> Question:"]
    assert over(spark, texts, tx.until_stop) == ["a ", "a", "plain", "", "x"]


def test_exact_match(spark):
    rows = [("#### 1,234.", "steps\n#### 1234"), ("$5", "5"), ("ABC", "abc"), ("1", "2"), (None, "2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string")
    got = [r[0] for r in df.orderBy("i").select(scoring.exact_match(F.col("p"), F.col("t"))).collect()]
    assert got == [1.0, 1.0, 1.0, 0.0, 0.0]


def test_prompts(spark):
    assert one(spark, tx.question_prompt(F.lit("q?"))) == "Question: q?\nAnswer:"
    choices = F.array(*[F.lit(c) for c in "vwxyz"])
    assert one(spark, tx.lettered_prompt(F.lit(" q?\n"), choices)) == "Question: q?\nA. v\nB. w\nC. x\nD. y\nE. z\nAnswer:"
    assert one(spark, tx.gold_index(choices, F.lit("x"))) == 2
    assert one(spark, tx.gold_index(choices, F.lit("q"))) is None
    assert one(spark, tx.activity_query(F.lit("Act"), F.lit("He runs."), F.lit("then HE stops"))) == "Act: He runs. Then he stops"
    sentence, options = F.lit("Ann beat Bob as _ was fast. "), F.array(F.lit("Ann"), F.lit("Bob"))
    assert one(spark, tx.blank_contexts(sentence, options)) == ["Ann beat Bob as Ann", "Ann beat Bob as Bob"]
    assert one(spark, tx.blank_continuation(sentence)) == "was fast."
    assert one(spark, tx.blank_contexts(F.lit("no blank"), options)) is None
    assert over(spark, ["1", "2", "3"], tx.blank_gold) == [0, 1, None]
    assert one(spark, tx.with_target(F.lit("Q"), F.lit("A"))) == "Q A"


def test_accuracy(spark):
    df = spark.createDataFrame([("t", 1.0)] * 3 + [("t", 0.0)] * 2, "task string, correct double")
    r = scoring.accuracy(df, ["task"]).first()
    assert (r.acc, r.n) == (pytest.approx(0.6), 5)
    assert r.acc_stderr == pytest.approx(math.sqrt(0.6 * 0.4 / 4))


def test_recorded_standard_errors(spark):
    """Accuracy and count of a published result give its published standard error."""
    n, acc, err = 1172, 0.4812286689419795, 0.014601090150633966
    hits = round(acc * n)
    df = spark.range(n).selectExpr("'arc' task", f"cast(id < {hits} as double) correct")
    r = scoring.accuracy(df, ["task"]).first()
    assert r.acc == pytest.approx(acc, abs=1e-15) and r.acc_stderr == pytest.approx(err, abs=1e-15)


def test_multiple_choice(spark):
    df = spark.createDataFrame(
        [(1, [-4.0, -6.0], ["ab", "abcdef"], 0), (2, [-4.0, -6.0], ["ab", "abcdef"], 1), (3, [1.0, 1.0], ["a", "b"], 0)],
        "i int, scores array<double>, choices array<string>, gold int",
    )
    got = [(r.acc, r.acc_norm) for r in scoring.multiple_choice(df).orderBy("i").collect()]
    assert got == [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("n,salts", [(3, 1), (3, 64), (1500, 8), (0, 4)])
def test_limit_per_task_with_a_hot_task(spark, n, salts):
    hot = spark.range(0, 3000, 1, 6).selectExpr("'hot' task", "id doc_id")
    cold = spark.range(5).selectExpr("'cold' task", "id doc_id")
    got = scoring.limit_per_task(hot.union(cold), n, salts=salts).collect()
    found = {t: sorted(r.doc_id for r in got if r.task == t) for t in ("hot", "cold")}
    assert found == {"hot": list(range(min(n, 3000))), "cold": list(range(min(n, 5)))}


def test_sample_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "task string, doc_id int")
    got = {r.task: (r.original, r.effective) for r in scoring.sample_counts(df, df.filter("doc_id < 2 and task = 'a'")).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_few_shot_context(spark):
    import hashlib

    train = spark.range(20).selectExpr("id row_id", "concat('ex', id) example")
    order = sorted(range(20), key=lambda i: hashlib.md5(f"{i}-1".encode()).hexdigest())[:3]
    context = scoring.shots_context(train, 3, "row_id", "example", 1)
    assert context.first().context == "\n\n".join(f"ex{i}" for i in order)
    asked = scoring.with_context(spark.createDataFrame([("q",)], "q string"), context, "q")
    assert asked.first().prompt == "\n\n".join(f"ex{i}" for i in order) + "\n\nq"
