"""Row numbers without gaps over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tallyforge.sources import scratch


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Numbers from 0 in order of (bucket, order). Buckets follow the order of rows; each is sorted in one task.

    Counts by bucket, summed up over the buckets (a row a bucket), give each bucket's first number. ``df`` is evaluated twice.
    """
    rows = df.withColumn("_b", bucket)
    count = rows.groupBy(F.col("_b").alias("_k")).agg(F.count("*").alias("_n"))
    first = count.select("_k", (F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return placed.join(first, placed["_b"].eqNullSafe(first["_k"])).withColumn(name, (F.col("_first") + F.col("_r") - 1).cast("long")).drop("_b", "_k", "_n", "_first", "_r")


def dense(df: DataFrame, by: str, name: str) -> DataFrame:
    """Numbers from 0 in order of a column of any orderable type, nulls first; rows of one value are numbered in some order.

    Rows are dealt to range partitions once (bounds from Spark's own sample) and written with their partition's number, so counts and
    ranks see the same rows. Each row's place breaks ties, so one value may fill many partitions.
    """
    ties = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = scratch.written(ties.repartitionByRange(F.col(by), F.col("_tie")).withColumn("_part", F.spark_partition_id()), "ranges")
    return numbered(rows, F.col("_part"), [F.col(by), F.col("_tie")], name).drop("_tie", "_part")


def shuffle_key(key: Column, seed: int) -> Column:
    """MD5 of ``<seed>:<key>``: an order that looks random and that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """Numbers from 0 in the order of ``shuffle_key``, then key. Buckets are the first four hex digits: 65,536, alike in size."""
    return numbered(df.withColumn("_h", shuffle_key(F.col(key), seed)), F.left("_h", F.lit(4)), [F.col("_h"), F.col(key)], name).drop("_h")
