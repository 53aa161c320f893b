"""Numbers in text, by a grammar that doesn't depend on an engine's casts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tallyforge.functions.text import extracted, strip

#: What counts as a number. Casts accept more (1d, 0x1p3) or less, so the form is tested first.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NAMED, NOT_A_NUMBER = r"(?i)^\s*[+-]?(inf(inity)?|nan)\s*$", r"(?i)^\s*[+-]?nan\s*$"
#: Numbers this near count as equal.
TOLERANCE = 1e-6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once. An expression that names its input several times, fed to another such
    expression, would else grow with each level until it can't be compiled."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_number(c: Column) -> Column:
    """A double, or null for text that isn't a number. Underscores and non-ASCII digits aren't."""
    named = F.when(c.rlike(NOT_A_NUMBER), F.lit(float("nan"))).when(c.contains("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double")).when(c.rlike(NAMED), named)


def rounded_number(c: Column) -> Column:
    """``to_number`` to five places."""
    return F.round(to_number(c), 5)


def loose_number(c: Column) -> Column:
    """A double after white space and thousands commas have gone; a percentage counts as its hundredth part."""
    return let(without_commas(c), percent_number)


def without_commas(c: Column) -> Column:
    return F.replace(strip(c), F.lit(","), F.lit(""))


def percent_number(c: Column) -> Column:
    """``to_number``, or the hundredth part of what is before a percent sign."""
    return F.when(c.endswith("%"), to_number(F.regexp_replace(c, "%$", "")) / 100.0).otherwise(to_number(c))


def near(a: Column, b: Column) -> Column:
    """Within the tolerance; false for not-a-number and for two infinities, null if either is null."""
    return F.abs(a - b) < F.lit(TOLERANCE)


def plain_fraction(c: Column) -> Column:
    r"""``\dfrac`` written as ``\frac``."""
    return F.when(c.contains("\\dfrac"), F.regexp_replace(c, r"(?d)\\dfrac\{(.*?)\}\{(.*?)\}", r"\\frac{$1}{$2}")).otherwise(c)


#: A fraction of integers at the start; what follows is ignored.
INTEGER_FRACTION = r"^\\frac\{(\d+)\}\{(\d+)\}"
ANY_FRACTION = r"(?d)^\\frac\{(.*)\}\{(.*)\}"


def _part(c: Column, pattern: str, group: int) -> Column:
    """A group of a leading fraction. Few answers are fractions, so a look at the beginning saves the pattern."""
    return F.when(c.startswith("\\frac{"), extracted(c, pattern, group))


def integer_fraction(c: Column) -> tuple[Column, Column]:
    """(value, whether the denominator is zero) of a leading fraction of integers; the value is null if there is none."""
    top, under = (_part(c, INTEGER_FRACTION, g).try_cast("double") for g in (1, 2))
    return F.try_divide(top, under), F.coalesce(under == 0, F.lit(False))


def any_fraction(c: Column) -> Column:
    """The value of a leading fraction whose parts are loose numbers, null otherwise and for a zero denominator."""
    return F.try_divide(*(loose_number(part) for part in fraction_parts(c)))


def fraction_parts(c: Column) -> tuple[Column, Column]:
    """What stands over and under the line of a leading fraction, as text."""
    return _part(c, ANY_FRACTION, 1), _part(c, ANY_FRACTION, 2)


def token_estimate(*texts: Column) -> Column:
    """A fourth of the code points, rounded down."""
    total = F.lit(0)
    for t in texts:
        total = total + F.coalesce(F.length(t), F.lit(0))
    return F.floor(total / F.lit(4)).cast("long")


def steps(rows: Column, batch: int) -> Column:
    """Batches that rows take, the last one partly filled."""
    return F.ceil(rows / F.lit(batch)).cast("long")


def gpu_count(heads: Column, most: int = 8) -> Column:
    """The largest count up to ``most`` that divides both the heads and 64."""
    return F.array_max(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (heads % n == 0) & (F.lit(64) % n == 0)))
