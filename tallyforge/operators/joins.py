"""Joins of responses to requests and answers: by key with the last one winning, and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.operators.ordinals import dense


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with each key's value of the greatest order; partial results are merged, so hot keys don't gather."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def answered(responses: DataFrame, requests: DataFrame, answers: DataFrame, order: str = "row_id", present: Column | None = None) -> DataFrame:
    """Responses (custom_id, ...) with ``question`` of their request and ``gold`` of that question.

    Requests are (custom_id, question, order), answers (question, gold, order); of duplicates on these sides the last one that has a question or
    gold wins: one without doesn't undo an earlier one.
    Responses with an empty or unknown id or a question without gold are left out, and those for which ``present`` (say, a box in the
    text) isn't true; repeated responses stay.
    """
    if present is not None:
        responses = responses.where(present)
    asked = last_wins(requests.where("question is not null"), "custom_id", "question", order)
    known = last_wins(answers.where("gold is not null"), "question", "gold", order)
    return responses.where(F.col("custom_id") != "").join(asked, "custom_id").join(known, "question")


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """The i-th row of one with the i-th of the other (``position`` from 0), as far as the shorter goes.

    Filter before: positions are counted among the rows that are there.
    """
    return dense(a, order_a, "position").join(dense(b, order_b, "position"), "position")


def length_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_left, n_right, matched, mismatch."""
    of = lambda df, left: df.select(F.lit(left).alias("left"))
    sides = of(a, True).union(of(b, False)).agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right"))
    return sides.select("n_left", "n_right", F.least("n_left", "n_right").alias("matched"), (F.col("n_left") != F.col("n_right")).alias("mismatch"))
