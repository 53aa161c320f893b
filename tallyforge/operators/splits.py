"""Seeded shuffles, splits and mixtures: sizes are exact, and an order can be repeated in any engine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import DataFrame, functions as F

from tallyforge.operators.ordinals import shuffled
from tallyforge.sources import scratch


def first_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    return df.where(F.col(order) < n)


def slice_rows(df: DataFrame, start: int, end: int, order: str = "row_id") -> DataFrame:
    return df.where((F.col(order) >= start) & (F.col(order) < end))


def three_way(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """With ``split``: the first int(n x train) of the shuffled rows, those to int(n x (train + val)), and the rest."""
    n = df.count()
    a, b = int(n * train), int(n * (train + val))
    return shuffled(df, key, seed, "_at").withColumn("split", F.when(F.col("_at") < a, "train").when(F.col("_at") < b, "val").otherwise("test")).drop("_at")


def held_out(df: DataFrame, key: str, percent: float = 5, seed: int = 42, names: tuple[str, str] = ("train", "eval")) -> DataFrame:
    """With ``split``: the last int(n x percent / 100) of the shuffled rows are held out."""
    n = df.count()
    return shuffled(df, key, seed, "_at").withColumn("split", F.when(F.col("_at") < n - int(n * percent / 100), names[0]).otherwise(names[1])).drop("_at")


def subsample(df: DataFrame, key: str, weight: float, seed: int = 0) -> DataFrame:
    """The first int(n x weight) of the shuffled rows."""
    return shuffled(df, key, seed, "_at").where(F.col("_at") < floor(df.count() * weight)).drop("_at")


@dataclass(frozen=True)
class Part:
    """A source of a mixture; a null weight takes all rows as they are."""

    rows: DataFrame
    key: str
    columns: tuple[str, ...] | None = None
    weight: float | None = 1.0


def mixture(parts: list[Part], seed: int = 0, test_size: float | None = None) -> DataFrame:
    """Columns, subsample, concatenation and shuffled ``position``; with ``split`` (train, test) if a test size is given.

    Each part keeps its key as ``_key`` prefixed by its number, which makes the order of the whole. Keys alone are drawn and ranked; the other
    columns are moved once, to join them. A list without parts, parts of different columns and repeated keys raise ValueError.
    """
    if not parts:
        raise ValueError("a mixture needs a source")
    if len({frozenset(p.columns or p.rows.columns) for p in parts}) > 1:
        raise ValueError("all sources of a mixture need the same columns")
    keys, texts = [], []
    for i, p in enumerate(parts):
        key = F.concat(F.lit(f"{i}:"), F.col(p.key).cast("string")).alias("_key")
        own = p.rows.select(p.key)
        keys.append((own if p.weight is None else subsample(own, p.key, p.weight, seed)).select(key))
        texts.append(p.rows.select(key, *(p.columns or p.rows.columns)))
    drawn = scratch.written(reduce(DataFrame.union, keys), "mixture-keys")
    n, different = drawn.agg(F.count("*"), F.countDistinct("_key")).first()
    if different < n:
        raise ValueError("keys of a mixture's sources must differ")
    placed = shuffled(drawn, "_key", seed, "position")
    if test_size is not None:
        placed = placed.withColumn("split", F.when(F.col("position") < n - int(n * test_size), "train").otherwise("test"))
    return reduce(DataFrame.unionByName, texts).join(placed, "_key")
