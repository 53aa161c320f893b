"""Token arrays: masks, padding, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyforge.functions.numbers import let
from tallyforge.functions.text import words

#: Fixed value: labels that the loss leaves out.
IGNORED = -100


def label_mask(ids: Column, source_len: Column, ignored: int = IGNORED) -> Column:
    """Labels: the ids, with those of the prompt ignored."""
    return F.transform(ids, lambda x, i: F.when(i < source_len, F.lit(ignored)).otherwise(x))


def truncated(ids: Column, most: int = 4096) -> Column:
    return F.slice(ids, 1, most)


def token_count(ids: Column, pad: int) -> Column:
    return F.size(F.filter(ids, lambda x: x != pad))


def padded(ids: Column, to: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(to - F.size(ids), F.lit(0)).cast("int")))


def attention(ids: Column, pad: int) -> Column:
    """Whether a position isn't padding; real tokens equal to the pad id count as padding."""
    return F.transform(ids, lambda x: x != pad)


def mask_length(mask: Column) -> Column:
    """Positions that a mask lets through."""
    return F.aggregate(mask, F.lit(0), lambda a, x: a + F.when(x, 1).otherwise(0))


def ngrams(text: Column, n: int) -> Column:
    """Word n-grams, each joined by a blank (arrays of arrays compare several times slower); none for fewer words."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words(text), lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<string>")))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Arrays of numbers of one length, each pair within the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(tolerance)), lambda ok: ok)
