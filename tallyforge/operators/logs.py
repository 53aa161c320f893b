"""Segments of an inference log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tallyforge.functions.text import around, log_index, strip


#: Lines that one task numbers.
BLOCK = 1 << 16


def segments(lines: DataFrame, file: str = "file", order: str = "row_id", line: str = "value", block: int = BLOCK) -> DataFrame:
    """file, segment, gsm8k_index, body, question, answer: one row a header line, also for repeated indices.

    A segment's body is the lines after its header, each stripped, joined by line breaks; what follows on the header line
    and what precedes the first header is left out. question and answer are before and after the first ``assistant``, stripped;
    null without one. A line's segment is the number of headers up to it: those of earlier blocks of ``block`` line numbers, summed
    up from one count a block, and those of its own block. So a file of any size is numbered by many tasks.
    """
    index = log_index(F.col(line))
    marked = lines.select(file, order, F.col(line), index.alias("_index"), F.floor(F.col(order) / F.lit(block)).alias("_block"))
    heads = marked.groupBy(F.col(file).alias("_f"), F.col("_block").alias("_k")).agg(F.count("_index").alias("_n"))
    before = heads.select("_f", "_k", (F.sum("_n").over(Window.partitionBy("_f").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = F.count("_index").over(Window.partitionBy(file, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("_own", own).join(before, (F.col(file) == F.col("_f")) & (F.col("_block") == F.col("_k")))
    numbered = counted.withColumn("segment", F.col("_before") + F.col("_own")).where("segment > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("_index").isNull(), F.struct(F.col(order).alias("k"), strip(F.col(line)).alias("v")))))
    told = numbered.groupBy(file, "segment").agg(F.max("_index").alias("gsm8k_index"), F.array_join(F.transform(body, lambda x: x["v"]), "\n").alias("body"))
    question, answer = around(F.col("body"), "assistant")
    return told.withColumn("question", strip(question)).withColumn("answer", strip(answer))


def selected(log: DataFrame, wanted: DataFrame, index: str = "gsm8k_index") -> DataFrame:
    """Segments with both parts whose index is wanted."""
    return log.where(F.col("question").isNotNull()).join(wanted.select(index), index, "left_semi")
