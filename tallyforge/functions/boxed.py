r"""What stands in ``\boxed{...}``: six extractors that disagree on nesting and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyforge.functions.numbers import let
from tallyforge.functions.text import extracted, strip

MARK = "\\boxed{"
#: A number; anything up to the first closing brace; content with braces nested once.
NUMERIC = r"\\boxed\{(-?\d+(?:\.\d+)?)\}"
SIMPLE = r"\\boxed\{([^}]+)\}"
NESTED = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"


def first_numeric(c: Column) -> Column:
    return extracted(c, NUMERIC)


def all_simple(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SIMPLE), F.lit(1))


def last_simple(c: Column) -> Column:
    return F.try_element_at(all_simple(c), F.lit(-1))


def all_nested(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NESTED), F.lit(1))


def first_nested(c: Column) -> Column:
    """The first, stripped; null if there is none or nothing in it."""
    return F.nullif(strip(F.try_element_at(all_nested(c), F.lit(1))), F.lit(""))


def last_nested(c: Column) -> Column:
    return F.try_element_at(all_nested(c), F.lit(-1))


def without_leftover_mark(c: Column) -> Column:
    """An answer that still holds a mark loses it and the closing braces at its end."""
    return F.when(c.contains("\\boxed"), F.rtrim(F.replace(c, F.lit(MARK), F.lit("")), F.lit("}"))).otherwise(c)


#: Fixed value: where a text is parted for folds over braces, behind each of them. A mark is the end of a part.
BEHIND_BRACES = r"(?<=[{}])"


def _parts(c: Column) -> Column:
    return F.split(c, BEHIND_BRACES)


def all_balanced(c: Column) -> Column:
    """All contents with balanced braces, from left to right; one that never closes ends the search behind its mark.

    Braces nest without bound, which no regular expression follows. This folds over the parts between braces, so a step a brace, not a character,
    keeps depth and places, and cuts the contents out at the end. It stays in the JVM. Texts without a mark aren't folded.
    """
    spot = "array<struct<begin: int, size: int>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array().cast(spot).alias("found"))

    def step(s: Column, part: Column) -> Column:
        inside, at = s["depth"] > 0, s["at"] + F.length(part)
        mark = ~inside & part.endswith(MARK)
        depth = F.when(mark, 1).when(~inside, 0).when(part.endswith("{"), s["depth"] + 1).when(part.endswith("}"), s["depth"] - 1).otherwise(s["depth"])
        box = F.struct((s["begin"] + 1).alias("begin"), (at - s["begin"] - 1).alias("size"))
        found = F.when((s["depth"] == 1) & part.endswith("}"), F.concat(s["found"], F.array(box))).otherwise(s["found"])
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(mark, at).otherwise(s["begin"]).alias("begin"), found.alias("found"))

    def boxes(text: Column) -> Column:
        return F.transform(F.aggregate(_parts(text), start, step, lambda s: s["found"]), lambda b: F.substring(text, b["begin"], b["size"]))

    return F.when(c.contains(MARK), let(c, boxes)).when(c.isNotNull(), F.array().cast("array<string>"))


def last_balanced(c: Column) -> Column:
    """What follows the last mark up to its own closing brace; null without a mark or if it isn't closed.

    A fold over the parts between braces behind the last mark; it stays in the JVM.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.length(part)
        depth = s["depth"] + F.when(part.endswith("{"), 1).when(part.endswith("}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] < 0) & (depth == 0), at - 1).otherwise(s["end"]).alias("end"))

    def closed(tail: Column) -> Column:
        return let(F.aggregate(_parts(tail), start, step, lambda s: s["end"]), lambda end: F.when(end >= 0, F.left(tail, end)))

    return let(F.when(c.contains(MARK), F.substring_index(c, MARK, -1)), closed)
