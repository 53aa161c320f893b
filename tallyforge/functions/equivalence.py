"""When two answers count as equal: five rules, each null-free (a null answer equals nothing)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import boxed
from tallyforge.functions.numbers import TOLERANCE, any_fraction, fraction_parts, integer_fraction, let, loose_number, near, percent_number, plain_fraction, to_number, without_commas
from tallyforge.functions.text import numbers_in, strip, strip_quotes, without_space


def _same(v: Column, clean: Callable[[Column], Column]) -> Column:
    """The comparison of the numbers v.x and v.y where both are, else that of the texts v.a and v.b, which only then are cleaned."""
    return F.coalesce(near(v["x"], v["y"]), clean(v["a"]) == clean(v["b"]), F.lit(False))


def _values(**named: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in named.items()])


def plain(a: Column, b: Column) -> Column:
    """Numbers within the tolerance, else stripped text."""
    return let(_values(a=a, b=b), lambda v: let(_values(x=to_number(v["a"]), y=to_number(v["b"]), a=v["a"], b=v["b"]), lambda w: _same(w, strip)))


def _fractions(v: Column, clean: Callable[[Column], Column]) -> Column:
    """The comparison of v.a and v.b where a leading fraction of integers is a number and one over zero equals nothing."""
    (x, x0), (y, y0) = integer_fraction(v["a"]), integer_fraction(v["b"])
    parts = _values(x=F.coalesce(x, to_number(v["a"])), y=F.coalesce(y, to_number(v["b"])), bad=x0 | y0, a=v["a"], b=v["b"])
    return let(parts, lambda w: ~w["bad"] & _same(w, clean))


def with_fractions(a: Column, b: Column) -> Column:
    """As ``plain``, and a leading fraction of integers is a number; a zero denominator equals nothing."""
    return let(_values(a=plain_fraction(a), b=plain_fraction(b)), lambda v: _fractions(v, strip))


def lenient(a: Column, b: Column, last_box: Callable[[Column], Column] = boxed.last_nested) -> Column:
    """As ``with_fractions`` on text without outer quotes, both boxes opened if both have one, and text compared without any white space.

    ``last_box`` takes the last box; the default follows braces nested once and stays in the JVM, ``balanced_box`` follows all.
    """
    a, b = (plain_fraction(strip_quotes(strip(c))) for c in (a, b))

    def opened(v: Column) -> Column:
        both = v["p"].isNotNull() & v["q"].isNotNull()
        return _values(a=F.when(both, v["p"]).otherwise(v["a"]), b=F.when(both, v["q"]).otherwise(v["b"]))

    return let(_values(a=a, b=b, p=last_box(a), q=last_box(b)), lambda v: let(opened(v), lambda w: _fractions(w, without_space)))


def with_lenient(df: DataFrame, a: Column, b: Column, name: str, last_box: Callable[[Column], Column] = boxed.last_nested) -> DataFrame:
    """``df`` with ``lenient(a, b, last_box)`` as column ``name``, by one projection a step.

    Each value has a column of its own, so it is computed once and in generated code; as one expression, values are bound by
    lambda functions, which are interpreted.
    """
    x, y, p, q = (F.col(f"_{n}") for n in "xypq")
    both = p.isNotNull() & q.isNotNull()
    steps = [{"_x": strip(a), "_y": strip(b)}, {"_x": plain_fraction(strip_quotes(x)), "_y": plain_fraction(strip_quotes(y))}, {"_p": last_box(x), "_q": last_box(y)}]
    steps += [{"_x": F.when(both, p).otherwise(x), "_y": F.when(both, q).otherwise(y)}]
    (m, m0), (n, n0) = integer_fraction(x), integer_fraction(y)
    steps += [{"_p": F.coalesce(m, to_number(x)), "_q": F.coalesce(n, to_number(y)), "_bad": m0 | n0}]
    steps += [{name: ~F.col("_bad") & F.coalesce(near(p, q), without_space(x) == without_space(y), F.lit(False))}]
    for step in steps:
        df = df.withColumns(step)
    return df.drop("_x", "_y", "_p", "_q", "_bad")


def with_loose(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """``df`` with ``loose(a, b)`` as column ``name``, by one projection a step as in ``with_lenient``."""
    texts = ("_x", "_xt", "_xu", "_y", "_yt", "_yu")
    df = df.withColumns({"_x": plain_fraction(a), "_y": plain_fraction(b)})
    for side in ("_x", "_y"):
        df = df.withColumns(dict(zip((f"{side}t", f"{side}u"), fraction_parts(F.col(side)), strict=True)))
    df = df.withColumns({t: without_commas(F.col(t)) for t in texts})
    value = lambda side: F.coalesce(F.try_divide(percent_number(F.col(f"{side}t")), percent_number(F.col(f"{side}u"))), percent_number(F.col(side)))
    df = df.withColumns({"_p": value("_x"), "_q": value("_y")})
    return df.withColumn(name, F.coalesce(near(F.col("_p"), F.col("_q")), strip(F.col("_x")) == strip(F.col("_y")), F.lit(False))).drop(*texts, "_p", "_q")


def balanced_box(c: Column) -> Column:
    """The last box by the balanced scan, which sees only texts that have a mark."""
    return F.try_element_at(boxed.all_balanced(F.when(c.contains(boxed.MARK), c)), F.lit(-1))


def by_numbers(a: Column, b: Column, strict: bool = False) -> Column:
    """``plain``, or as many numbers on both sides, each within the tolerance, or equal without white space.

    Two answers without any number have the same (no) numbers and so are equal; ``strict`` asks for one at least.
    """

    def alike(v: Column) -> Column:
        close = F.forall(F.zip_with(v["x"], v["y"], lambda p, q: F.abs(p.cast("double") - q.cast("double")) <= F.lit(TOLERANCE)), lambda ok: ok)
        return (F.size(v["x"]) == F.size(v["y"])) & close & ((F.size(v["x"]) > 0) | F.lit(not strict))

    same = let(_values(x=numbers_in(a), y=numbers_in(b)), alike)
    return plain(a, b) | F.coalesce(same, F.lit(False)) | F.coalesce(without_space(a) == without_space(b), F.lit(False))


def loose(a: Column, b: Column) -> Column:
    """Thousands commas, percentages and fractions of such numbers count; else stripped text."""
    bare = lambda c: strip(without_commas(c))
    number = lambda c: F.coalesce(any_fraction(c), loose_number(c))
    parts = lambda v: _values(x=number(v["a"]), y=number(v["b"]), a=v["a"], b=v["b"])
    return let(_values(a=plain_fraction(a), b=plain_fraction(b)), lambda v: let(parts(v), lambda w: _same(w, bare)))


def sampled_hit(prediction: Column, gold: Column) -> Column:
    """Rounded numbers alike; two that aren't numbers are alike too."""
    return prediction.eqNullSafe(gold)
