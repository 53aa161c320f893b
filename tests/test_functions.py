"""Truth tables of extractors, equivalence rules and scores."""

import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import arrays, boxed, equivalence, external, numbers, rewards, text
from tallyforge.operators import scoring

RULES = {
    "plain": equivalence.plain,
    "with_fractions": equivalence.with_fractions,
    "lenient": equivalence.lenient,
    "by_numbers": equivalence.by_numbers,
    "loose": equivalence.loose,
}
#: a, b, and the verdict of each rule in turn.
TABLE = [
    ("42", "42.0", "TTTTT"), ("0.3333333", "0.3333334", "TTTTT"), ("0.333", "0.334", "FFFFF"), ("1,000", "1000", "FFFFT"), ("50%", "0.5", "FFFFT"),
    ("\\frac{1}{2}", "0.5", "FTTFT"), ("\\dfrac{1}{2}", "\\frac{1}{2}", "FTTTT"), ("\\frac{1}{2}x", "0.5", "FTTFT"), ("-\\frac{1}{2}", "-0.5", "FFFFF"),
    ("\\frac{1}{0}", "\\frac{1}{0}", "TFFTT"), ("x", "y", "FFFTF"), ("-5", "5", "FFFTF"), ("a b", "ab", "FFTTF"), (" 7 ", "7", "TTTTT"), ('"7"', "7", "FFTTF"),
    ("nan", "nan", "FFFTF"), ("inf", "inf", "FFFTF"), ("1d", "1", "FFFTF"), ("\\boxed{3}", "\\boxed{3.0}", "FFTTF"), ("(1,2)", "(1, 2)", "FFTTF"), ("", "", "TTTTT"),
    ("5 apples", "5", "FFFTF"), ("\\frac{1.5}{3}", "0.5", "FFFFT"), ("1.0000001", "1", "TTTTT"), (None, "1", "FFFFF"), (None, None, "FFFFF"),
]

#: text; first numeric, last simple, first nested, all nested, balanced scan, balanced from the last mark.
BOXES = [
    ("\\boxed{42}", "42", "42", "42", ["42"], ["42"], "42"),
    ("\\boxed{-3.5} then \\boxed{7}", "-3.5", "7", "-3.5", ["-3.5", "7"], ["-3.5", "7"], "7"),
    ("\\boxed{\\frac{1}{2}}", None, "\\frac{1", "\\frac{1}{2}", ["\\frac{1}{2}"], ["\\frac{1}{2}"], "\\frac{1}{2}"),
    ("\\boxed{\\boxed{5}}", "5", "\\boxed{5", "\\boxed{5}", ["\\boxed{5}"], ["\\boxed{5}"], "5"),
    ("\\boxed{a \\boxed{b}", None, "a \\boxed{b", "b", ["b"], [], "b"),
    ("\\boxed{{1}}", None, "{1", None, [], ["{1}"], "{1}"),
    ("\\boxed{\\sqrt{\\frac{1}{2}}}", None, "\\sqrt{\\frac{1", None, [], ["\\sqrt{\\frac{1}{2}}"], "\\sqrt{\\frac{1}{2}}"),
    ("\\boxed{}", None, None, None, [], [""], ""),
    ("\\boxed{1,080}", None, "1,080", "1,080", ["1,080"], ["1,080"], "1,080"),
    ("no box", None, None, None, [], [], None),
    ("\\boxed{ 8 } and \\boxed{9", None, " 8 ", "8", [" 8 "], [" 8 "], None),
]


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("i", range(5))
def test_equivalence_table(spark, i):
    rule = list(RULES.values())[i]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(TABLE)], "k int, a string, b string")
    got = [r["x"] for r in rows.select("k", rule(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()]
    assert ["FT"[x] for x in got] == [v[i] for _, _, v in TABLE]


def test_strict_numbers(spark):
    rows = spark.createDataFrame([("x", "y")], "a string, b string")
    assert rows.select(equivalence.by_numbers(F.col("a"), F.col("b"), strict=True)).first()[0] is False


def test_lenient_follows_deep_boxes_with_the_scan(spark):
    rows = spark.createDataFrame([("\\boxed{\\sqrt{\\frac{1}{2}}}", "\\boxed{\\sqrt{\\frac{1}{2}} }")], "a string, b string")
    assert rows.select(equivalence.lenient(F.col("a"), F.col("b"), equivalence.balanced_box)).first()[0]


@pytest.mark.parametrize("k,build", list(enumerate([boxed.first_numeric, boxed.last_simple, boxed.first_nested, boxed.all_nested, boxed.all_balanced, boxed.last_balanced], 1)))
def test_boxes(spark, k, build):
    assert column(spark, [b[0] for b in BOXES] + [None], build) == [b[k] for b in BOXES] + [None]


def test_leftover_mark(spark):
    assert column(spark, ["\\boxed{5}", "a}", "\\boxed{\\boxed{5}}}"], boxed.without_leftover_mark) == ["5", "a}", "5"]


def test_numbers(spark):
    got = column(spark, ["1e3", " +5 ", ".5", "5.", "1d", "0x1p3", "1_000", "1,0", "", "-inf", "nan", None], numbers.to_number)
    assert got[:4] == [1000.0, 5.0, 0.5, 5.0] and got[4:9] == [None] * 5 and got[9] == -math.inf and math.isnan(got[10]) and got[11] is None
    assert column(spark, ["1,234.5", "50%", " 12% ", "x%", "x"], numbers.loose_number) == [1234.5, 0.5, 0.12, None, None]
    assert column(spark, ["0.1234567", "x"], numbers.rounded_number) == [0.12346, None]


def test_answers_of_problems(spark):
    answers = ["a #### 1,080", "#### -5", "#### 3.50", "none", "#### 1 #### 72"]
    assert column(spark, answers, text.marked_answer) == ["1", None, "3.50", None, "1"]
    assert column(spark, answers[:3] + answers[4:], text.digits_after_mark) == ["1080", "-5", "3.50", "72"]


def test_text(spark):
    assert column(spark, ["　a b ", " \t"], text.strip) == ["a b", ""]
    assert column(spark, ["a　b c"], text.without_space) == ["abc"]
    assert column(spark, ["\"'x'\""], text.strip_quotes) == ["x"]
    assert column(spark, ["aaaa", "xaa"], lambda c: text.count_of(c, "aa")) == [2, 1]
    assert column(spark, ["-5 and 2.5, -1.5 x .5"], text.numbers_in) == [["5", "2.5", "-1.5", ".5"]]
    assert column(spark, ["2024-01-02 03:04:05,678 - 样本 17 模型输出：x", "样本 3 模型输出：y"], text.log_index) == [17, None]
    assert column(spark, ["a/b.c/d.json", "a.b/c", ".hidden"], text.with_suffix) == ["a/b.c/d_filtered.json", "a.b/c_filtered", ".hidden_filtered"]
    assert column(spark, ["Mix-8x7B", "a-0.5b-300m", "none", "1.5M"], text.parameter_count) == [56_000_000_000, 500_000_000, -1, 1_500_000]
    assert column(spark, ["```python\n1\n```\n```python\n2\n```", "x"], text.last_code_block) == ["2\n", ""]
    assert column(spark, ["a,b"], lambda c: text.task_list("s", c, 2)) == ["s|a|2|0,s|b|2|0"]
    assert column(spark, ["a b/c"], text.sanitized_name) == ["a_b_c"]
    assert column(spark, ["the prompt  and more "], lambda c: text.after_prompt(c, F.lit("the prompt"))) == ["and more"]
    assert column(spark, ["x assistant y"], lambda c: text.after_last(c, "assistant")) == [" y"]


SHAPED = "<think>\na\n</think>\n<answer>\nb\n</answer>"


def test_shape_scores(spark):
    texts = [SHAPED, SHAPED + "\nmore", "x\n" + SHAPED, SHAPED + "x", "<think>\n<think>\n"]
    assert column(spark, texts, rewards.tagged) == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert column(spark, texts[:1] + texts[4:], rewards.tag_count) == [1.0, 0.0]
    assert column(spark, ["1. a\n2. b", "First, a\n- b\n* c\nFinally,", "Step 1: x"], rewards.reasoning_steps) == [pytest.approx(1 / 3), 1.0, pytest.approx(1 / 3)]


def test_length_score(spark):
    rows = spark.createDataFrame([(1, 10, True), (1, 20, False), (1, 30, None), (2, 5, True), (2, 5, False), (None, 1, True), (None, 3, True)], "g int, n int, ok boolean")
    rows = scoring.with_bounds(rows, F.col("n"), ["g"])
    got = [r["x"] for r in rows.select("g", "n", "ok", rewards.length(F.col("n"), F.col("ok"), F.col("low"), F.col("high")).alias("x")).orderBy("g", "n", F.desc("ok")).collect()]
    assert got == [0.5, -0.5, 0.5, 0.0, -0.5, 0.0, 0.0]


def test_cosine_score(spark):
    rows = spark.createDataFrame([(0, True), (1000, True), (0, False), (1000, False), (2000, True), (5, None)], "n int, ok boolean")
    got = [r["x"] for r in rows.select(rewards.Cosine()(F.col("n"), F.col("ok")).alias("x")).collect()]
    assert got == [pytest.approx(v) for v in (1.0, 0.5, 0.0, -0.5, 1.0, 1.0)]


@pytest.mark.parametrize("build", [rewards.repetition, lambda c: rewards.repetition_batches()(c)])
def test_repetition(spark, build):
    assert column(spark, ["a b c a b c", "a b", "", "a b c"], build) == [pytest.approx(-0.25), 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        rewards.repetition(F.col("v"), penalty=1.0)


def test_overlong(spark):
    assert column(spark, [12288, 14336, 16384, 16385], rewards.overlong, "int") == [0.0, -0.5, -1.0, -1.0]


def test_composite_and_accuracy(spark):
    rows = spark.createDataFrame([("r\n---\n\\boxed{1,000}", "\\boxed{1000}"), ("r\n---\n\\boxed{2}", "\\boxed{1}"), ("\\boxed{1}", "\\boxed{1}"), ("r --- x", "\\boxed{1}"), ("r --- \\boxed{1}", "1")], "c string, a string")
    assert [r[0] for r in rows.select(rewards.composite(F.col("c"), F.col("a"))).collect()] == [2.0, 0.2, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([("\\boxed{2}", "2.0"), ("\\boxed{3}", "2"), ("none", "2")], "completion string, solution string")
    assert [r[0] for r in rows.select(rewards.accuracy(F.col("completion"), F.col("solution"))).collect()] == [1.0, 0.0, None]


def test_registry(spark):
    with pytest.raises(ValueError):
        rewards.selected(["unheard_of"])
    rows = spark.createDataFrame([("First, \\boxed{2}", "2"), ("a b c a b c", "2"), (None, "2")], "completion string, solution string")
    scores = rewards.selected(["accuracy", "reasoning_steps", "repetition_penalty"])
    got = [r[0] for r in rows.select(rewards.weighted(scores)).collect()]
    assert got == [pytest.approx(1 + 0.2 / 3), pytest.approx(-0.1), pytest.approx(0.0)]


def test_batch_answer(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (None, 2, "e")], "g int, k int, a string")
    got = scoring.with_batch_answer(rows, F.col("a"), ["g"], "k", "x").orderBy("g", "k").collect()
    assert [r["x"] for r in got] == ["d", "d", "a", "a", "c"]


def test_arrays(spark):
    rows = spark.createDataFrame([([5, 0, 7],)], "ids array<int>")
    got = rows.select(arrays.label_mask(F.col("ids"), F.lit(2)).alias("l"), arrays.padded(F.col("ids"), F.lit(5), 0).alias("p"), arrays.attention(F.col("ids"), 0).alias("m"), arrays.token_count(F.col("ids"), 0).alias("n"), arrays.truncated(F.col("ids"), 2).alias("t")).first()
    assert got["l"] == [-100, -100, 7] and got["p"] == [5, 0, 7, 0, 0] and got["m"] == [True, False, True] and got["n"] == 2 and got["t"] == [5, 0]
    pair = spark.createDataFrame([([1.0, 2.0], [1.0, 2.1]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in pair.select(arrays.within(F.col("a"), F.col("b"), 0.2)).collect()] == [True, False, True]
    assert column(spark, ["A b  c", "a"], lambda c: arrays.ngrams(c, 2)) == [["a b", "b c"], []]


def test_boundaries(spark):
    rows = spark.createDataFrame([("a bb",), (None,), ("",)], "v string")
    assert [r[0] for r in rows.select(external.tokenizer(external.word_lengths)(F.col("v"))).collect()] == [[1, 2], None, []]
    assert [r[0] for r in rows.select(external.token_counts("words")(F.col("v"))).collect()] == [2, -1, 0]
    assert [r[0] for r in rows.select(external.token_counts("no such")(F.col("v"))).collect()] == [-1, -1, -1]

    def call(t):
        if t == "bad":
            raise RuntimeError("refused")
        return t.upper()

    asked = spark.createDataFrame([("x",), ("bad",), (None,)], "v string")
    got = external.remote_map(asked, "v", call, 2).collect()
    assert sorted((r["response"] or "", r["error"] or "") for r in got) == [("", "No user message found"), ("", "refused"), ("X", "")]
    made = external.generate(asked.where("v is not null"), "v", lambda ps: [[p + str(k) for k in range(2)] for p in ps], 2).collect()
    assert sorted(r["output"] for r in made) == ["bad0", "bad1", "x0", "x1"]
