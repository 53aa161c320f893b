"""Pass rates of sampled answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.equivalence import sampled_hit
from tallyforge.functions.numbers import rounded_number


def pass_rate(df: DataFrame, keys: list[str], prediction: Column, gold: Column, samples: int = 10) -> DataFrame:
    """keys, pass_rate: hits over ``samples``. A prediction and a gold answer that are both no numbers are a hit."""
    hit = sampled_hit(rounded_number(prediction), rounded_number(gold)).cast("int")
    return df.groupBy(*keys).agg((F.sum(hit) / F.lit(float(samples))).alias("pass_rate"))


def predictions(df: DataFrame, keys: list[str], sample: str, prediction: Column) -> DataFrame:
    """keys, predictions: an array in order of sample, nulls kept. A group has a row a sample."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("k"), prediction.alias("v")))), lambda x: x["v"]).alias("predictions"))


def rate_of(predictions: Column, gold: Column, samples: int = 10) -> Column:
    """The pass rate of an array of predictions."""
    want = rounded_number(gold)
    return F.aggregate(predictions, F.lit(0), lambda n, p: n + sampled_hit(rounded_number(p), want).cast("int")) / F.lit(float(samples))


def all_right(rates: DataFrame, rate: str = "pass_rate") -> DataFrame:
    return rates.where(F.col(f"`{rate}`") == 1)
