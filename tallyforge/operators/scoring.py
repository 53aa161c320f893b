"""Scores as columns of a table: one projection a step, and what they need of a whole batch by partial aggregates joined back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import boxed, equivalence, rewards
from tallyforge.functions.text import count_of


def _joined(df: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """``df`` with the other columns of ``found``, which has the group's as _g0, _g1, ...; null groups are groups."""
    same = reduce(lambda a, b: a & b, [df[g].eqNullSafe(found[f"_g{i}"]) for i, g in enumerate(group)])
    return df.join(found, same).drop(*[f"_g{i}" for i in range(len(group))])


def _by(df: DataFrame, group: list[str]):
    return df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])


def with_bounds(df: DataFrame, size: Column, group: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """With the least and the greatest size of a row's group."""
    return _joined(df, _by(df, group).agg(F.min(size).alias(low), F.max(size).alias(high)), group)


def with_batch_answer(df: DataFrame, answer: Column, group: list[str], order: Column | str, name: str = "batch_answer") -> DataFrame:
    """With the first answer of a row's group, by which all its completions are scored."""
    return _joined(df, _by(df, group).agg(F.min_by(answer, order).alias(name)), group)


def with_accuracy(df: DataFrame, completion: Column, solution: Column, name: str = "accuracy", last_box: Callable[[Column], Column] = equivalence.balanced_box, verified: Column | None = None) -> DataFrame:
    """With ``rewards.accuracy``."""
    df = equivalence.with_lenient(df.withColumn("_box", last_box(completion)), F.col("_box"), solution, "_same", last_box)
    own = F.when(F.col("_box").isNotNull(), F.col("_same").cast("double"))
    return df.withColumn(name, own if verified is None else F.coalesce(verified.cast("double"), own)).drop("_box", "_same")


def with_composite(df: DataFrame, completion: Column, answer: Column, name: str = "reward") -> DataFrame:
    """With ``rewards.composite``."""
    df = df.withColumns({"_gold": boxed.last_balanced(answer), "_mine": boxed.last_balanced(completion), "_ruled": count_of(completion, "---") == 1})
    df = equivalence.with_loose(df, F.col("_mine"), F.col("_gold"), "_same")
    usable = F.coalesce(F.col("_gold").isNotNull() & F.col("_mine").isNotNull() & F.col("_ruled"), F.lit(False))
    return df.withColumn(name, F.when(usable, F.when(F.col("_same"), F.lit(2.0)).otherwise(F.lit(0.2))).otherwise(F.lit(0.0))).drop("_gold", "_mine", "_ruled", "_same")


def with_scores(df: DataFrame, names: list[str], fields: rewards.Fields = rewards.Fields(), parameters: dict[str, dict] | None = None) -> DataFrame:  # noqa: B008
    """With the named scores of the registry, a column each; an unknown name raises ValueError."""
    columns = rewards.selected(names, fields, parameters)
    if "accuracy" in names:
        df = with_accuracy(df, F.col(fields.completion), F.col(fields.solution), **(parameters or {}).get("accuracy", {}))
    return df.withColumns({n: c for n, c in columns.items() if n != "accuracy"})
