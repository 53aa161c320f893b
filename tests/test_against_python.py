"""Rules against plain-Python readings of them, on thousands of strings glued from fragments that matter to them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import boxed, equivalence, rewards, text
from tallyforge.operators import scoring

FRAGMENTS = ["\\frac{", "\\dfrac{", "\\boxed{", "}{", "}", "{", "1", "2.5", "0", "-", "%", ",", " ", "x", '"', "e3", ".", "\n", "7", "é", "　"]
NUMBER = re.compile(r"[ \t\n\r\f\v]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\r\f\v]*")


def glued(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def number(s):
    return float(s) if NUMBER.fullmatch(s) else None


def loose_number(s):
    s = s.strip().replace(",", "")
    if s.endswith("%"):
        n = number(s[:-1])
        return None if n is None else n / 100
    return number(s)


def same(x, y, a, b):
    return abs(x - y) < 1e-6 if x is not None and y is not None else a == b


def one_frac(s):
    return re.sub(r"\\dfrac\{(.*?)\}\{(.*?)\}", lambda m: f"\\frac{{{m[1]}}}{{{m[2]}}}", s)


def fraction(s):
    """Value of a leading fraction of integers, else the number; ZeroDivisionError for one over zero."""
    m = re.match(r"\\frac\{([0-9]+)\}\{([0-9]+)\}", s)
    return float(m[1]) / float(m[2]) if m else number(s)


def plain(a, b):
    return same(number(a), number(b), a.strip(), b.strip())


def with_fractions(a, b):
    a, b = one_frac(a), one_frac(b)
    try:
        return same(fraction(a), fraction(b), a.strip(), b.strip())
    except ZeroDivisionError:
        return False


def partners(s):
    """Where each opening brace closes, from a stack over all marks and braces; a mark's brace is told by its place before the brace."""
    open_, closes = [], {}
    for m in re.finditer(r"[{}]", s):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            closes[open_.pop()] = m.start()
    return closes


def balanced(s):
    """Contents of boxes that lie in no other; none from a box on that isn't closed. Braces before a mark don't count."""
    head, mark, tail = s.partition("\\boxed")
    while mark and not tail.startswith("{"):
        more, mark, tail = tail.partition("\\boxed")
    end = partners(tail).get(0) if mark else None
    return [] if end is None else [tail[1:end], *balanced(tail[end + 1 :])]


def last_balanced(s):
    *before, tail = s.split("\\boxed{")
    end = partners("{" + tail).get(0)
    return tail[: end - 1] if before and end is not None else None


def lenient(a, b):
    a, b = (one_frac(s.strip().strip("\"'")) for s in (a, b))
    p, q = balanced(a), balanced(b)
    if p and q:
        a, b = p[-1], q[-1]
    try:
        return same(fraction(a), fraction(b), re.sub(r"\s+", "", a), re.sub(r"\s+", "", b))
    except ZeroDivisionError:
        return False


def numbers_of(s):
    return [float(x) for x in re.findall(r"[-+]?[0-9]*\.[0-9]+|[0-9]+", s)]


def by_numbers(a, b):
    x, y = numbers_of(a), numbers_of(b)
    return plain(a, b) or len(x) == len(y) and all(abs(p - q) <= 1e-6 for p, q in zip(x, y)) or re.sub(r"\s+", "", a) == re.sub(r"\s+", "", b)


def loose(a, b):
    def value(s):
        m = re.match(r"\\frac\{(.*)\}\{(.*)\}", s)
        if m:
            top, under = loose_number(m[1]), loose_number(m[2])
            if top is not None and under:
                return top / under
        return loose_number(s)

    a, b = one_frac(a), one_frac(b)
    clean = lambda s: s.strip().replace(",", "").strip()
    return same(value(a), value(b), clean(a), clean(b))


CASES = {
    "plain": (equivalence.plain, plain),
    "with_fractions": (equivalence.with_fractions, with_fractions),
    "lenient": (lambda a, b: equivalence.lenient(a, b, equivalence.balanced_box), lenient),
    "by_numbers": (equivalence.by_numbers, by_numbers),
    "loose": (equivalence.loose, loose),
}


@pytest.mark.parametrize("name", list(CASES))
def test_pairs(spark, name):
    rng = random.Random(5)
    left = glued(1, 1500, 7)
    right = [x if rng.random() < 0.3 else rng.choice([x.strip(), x.replace("\\dfrac", "\\frac"), x + " ", y]) for x, y in zip(left, glued(2, 1500, 4))]
    pairs = [*zip(left, right), *(("\\frac{" + str(a) + "}{" + str(b) + "}", str(a / max(b, 1))) for a in range(4) for b in range(4))]
    ours, theirs = CASES[name]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["x"] for r in rows.select("i", ours(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    want = [bool(theirs(a, b)) for a, b in pairs]
    assert [(p, g) for p, g, w in zip(pairs, got, want) if g != w] == []
    staged = {"lenient": lambda d: equivalence.with_lenient(d, F.col("a"), F.col("b"), "x", equivalence.balanced_box), "loose": lambda d: equivalence.with_loose(d, F.col("a"), F.col("b"), "x")}
    if name in staged:
        out = staged[name](rows)
        assert out.columns == ["i", "a", "b", "x"] and [r["x"] for r in out.orderBy("i").collect()] == got
    assert 50 < sum(want) < len(want) - 50


def one_column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_scans(spark):
    texts = glued(3, 1500, 12)
    assert one_column(spark, texts, boxed.all_balanced) == [balanced(t) for t in texts]
    assert one_column(spark, texts, boxed.last_balanced) == [last_balanced(t) for t in texts]
    assert one_column(spark, texts, text.strip) == [t.strip() for t in texts]
    assert one_column(spark, texts, boxed.all_nested) == [re.findall(r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}", t) for t in texts]


def test_staged_scores(spark):
    """Scores a step at a time are those of one expression."""
    texts = [*glued(6, 400, 9), None, "--- \\boxed{1}", "--- \\boxed{50%}", "a --- \\boxed{\\frac{1}{2}}"]
    rows = spark.createDataFrame([(t, g) for t in texts for g in ("\\boxed{1}", "1", "\\boxed{0.5}", None)], "completion string, solution string")
    c, g = F.col("completion"), F.col("solution")
    both = scoring.with_composite(scoring.with_scores(rows, ["accuracy", "tag_count"]), c, g).withColumns({"one": rewards.accuracy(c, g), "two": rewards.composite(c, g), "three": rewards.tag_count(c)})
    got = both.collect()
    assert all(r["accuracy"] == r["one"] and r["reward"] == r["two"] and r["tag_count"] == r["three"] for r in got)
    assert len({r["one"] for r in got}) == 3 and len({r["two"] for r in got}) == 3


def test_repetition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(300)]

    def want(t):
        w = t.lower().split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return -(1 - len(set(grams)) / len(grams)) if grams else 0.0

    for build in (rewards.repetition, lambda c: rewards.repetition_batches()(c)):
        assert all(math.isclose(a, want(t), abs_tol=1e-12) for a, t in zip(one_column(spark, texts, build), texts))
