"""Batches of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.arrays import IGNORED, attention, label_mask, padded, truncated


def batches(order: Column, size: int) -> Column:
    """The batch of a row number."""
    return F.floor(order / F.lit(size)).cast("long")


def collated(df: DataFrame, batch: str, ids: str, source_len: str, pad: int = 0, longest: int = 4096) -> DataFrame:
    """With input_ids, labels and attention_mask padded to the longest row of the batch.

    Only the batch's longest length is gathered, then joined back: token arrays aren't shuffled to find it, and not for the join either
    while the lengths, a row a batch, are small enough for Spark to broadcast.
    """
    cut = df.withColumn(ids, truncated(F.col(ids), longest))
    widest = cut.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size(ids)).alias("_to"))
    rows = cut.join(widest, F.col(batch) == F.col("_b"))
    rows = rows.withColumn("labels", padded(label_mask(F.col(ids), F.col(source_len)), F.col("_to"), IGNORED))
    rows = rows.withColumn("input_ids", padded(F.col(ids), F.col("_to"), pad))
    return rows.withColumn("attention_mask", attention(F.col("input_ids"), pad)).drop("_b", "_to")
