"""An extension: the same operators over files that keep arriving. The batch library doesn't need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Append ``transform`` of each new JSON-lines file to a Parquet folder, each file once; stops when all files are done."""
    rows = spark.readStream.schema(schema).json(source)
    return transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
