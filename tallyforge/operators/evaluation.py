"""Evaluation of predictions against gold answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import equivalence
from tallyforge.functions.external import verifier


def judged(rows: DataFrame, output: str, gold: str, last_box: Callable[[Column], Column] = equivalence.balanced_box, check: Callable[[str, str], bool | None] | None = None) -> DataFrame:
    """With ``verdict``: ``right``, ``wrong`` or ``skipped``, and ``method``: ``symbolic``, ``text`` or null if skipped.

    Without gold: skipped. The symbolic check, if there is one, sees the whole output and then the last box, and decides where it
    isn't null; else the last box is compared by ``equivalence.lenient``, and an output without a box is skipped. Rows that the first
    check has decided don't run the second.
    """
    has_gold = F.coalesce(F.col(gold), F.lit("")) != ""
    rows = rows.withColumn("_box", last_box(F.col(output)))
    symbolic = F.lit(None).cast("boolean")
    if check is not None:
        run = verifier(check)
        rows = rows.withColumn("_whole", run(F.when(has_gold, F.col(output)), F.col(gold)))
        rows = rows.withColumn("_boxed", run(F.when(has_gold & F.col("_whole").isNull(), F.col("_box")), F.col(gold)))
        symbolic = F.coalesce("_whole", "_boxed")
    rows = equivalence.with_lenient(rows, F.col("_box"), F.col(gold), "_same", last_box)
    text = F.when(F.col("_box").isNotNull(), F.col("_same"))
    right = F.when(has_gold, F.coalesce(symbolic, text))
    out = rows.withColumn("verdict", F.when(right.isNull(), "skipped").when(right, "right").otherwise("wrong")).withColumn("method", F.when(right.isNull(), F.lit(None)).when(symbolic.isNotNull(), "symbolic").otherwise("text"))
    return out.drop("_box", "_same", "_whole", "_boxed")


def summary(rows: DataFrame) -> DataFrame:
    """One row: total (right and wrong), correct, accuracy in percent (null without any), skipped, symbolic, text."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    out = rows.agg(is_("right").alias("correct"), is_("wrong").alias("wrong"), is_("skipped").alias("skipped"), F.count_if(F.col("method") == "symbolic").alias("symbolic"), F.count_if(F.col("method") == "text").alias("text"))
    total = F.col("correct") + F.col("wrong")
    return out.select(total.alias("total"), "correct", (F.lit(100.0) * F.col("correct") / F.nullif(total, F.lit(0))).alias("accuracy"), "skipped", "symbolic", "text")


def indices(rows: DataFrame, verdict: str, order: str) -> DataFrame:
    """Row numbers of a verdict, a row each. Give a written table of verdicts where several are asked for."""
    return rows.where(F.col("verdict") == verdict).select(order)


def index_preview(rows: DataFrame, verdict: str, order: str, n: int = 20) -> DataFrame:
    """One row: the count and the first n row numbers as an array, by a top-n of the sorted column."""
    few = indices(rows, verdict, order).orderBy(order).limit(n)
    return few.agg(F.array_sort(F.collect_list(order)).alias("first"))
