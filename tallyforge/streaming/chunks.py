"""Streamed responses put together: chunks by number, out of order, into reasoning and answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of chunks, and of responses.
CHUNK = "response_id string, seq long, choices array<struct<reasoning: string, content: string>>, last boolean"
RESPONSE = "response_id string, reasoning string, content string, chunks long, complete boolean"


class Fold(StatefulProcessor):
    """State of a response: its chunks so far by number, and the number of the last one once that is there.

    A response is given out, and its state dropped, when chunks 0 to the last are all there. One that waits ``patience`` ms longer is given out as it is,
    not complete. A chunk that comes again counts once; for ``patience`` ms after a response was given out its chunks are known as late and ignored.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", "reasoning string, content string")
        self.last = handle.getValueState("last", "seq long")
        self.done = handle.getValueState("done", "done boolean", self.patience)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        fresh = not self.parts.exists()
        for some in rows:
            for seq, choices, last in zip(some["seq"].tolist(), some["choices"], some["last"].tolist(), strict=True):
                reasoning, content = (choices[0]["reasoning"], choices[0]["content"]) if choices is not None and len(choices) else (None, None)
                # a chunk with reasoning has no answer
                self.parts.updateValue((int(seq),), (reasoning or "", "" if reasoning else content or ""))
                if last:
                    self.last.update((int(seq),))
        if self.last.exists():
            n = self.last.get()[0] + 1
            if sum(1 for _ in self.parts.keys()) >= n:
                yield self._row(key, True)
                return
        if fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.parts.exists():
            yield self._row(key, False)

    def close(self) -> None:
        pass

    def _row(self, key: tuple, complete: bool) -> pd.DataFrame:
        parts = sorted((k[0], v[0], v[1]) for k, v in self.parts.iterator())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.parts.clear()
        self.last.clear()
        self.done.update((True,))
        return pd.DataFrame({"response_id": [key[0]], "reasoning": ["".join(r for _, r, _ in parts)], "content": ["".join(c for _, _, c in parts)], "chunks": [len(parts)], "complete": [complete]})


def responses(chunks: DataFrame, patience: int = 600_000) -> DataFrame:
    """RESPONSE of a stream of CHUNK. A chunk without choices counts, but adds nothing; of one with several the first counts.

    Chunks of a response meet by its id, in any order and over any number of batches. State is as large as the responses that aren't complete. It needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps it on disk, and survives restarts by its checkpoint.
    """
    known = chunks.where("response_id is not null and seq is not null")
    return known.groupBy("response_id").transformWithStateInPandas(Fold(patience), RESPONSE, "Append", "ProcessingTime")


def responses_of_table(chunks: DataFrame) -> DataFrame:
    """RESPONSE of a table of CHUNK that holds all there will be: the same by one aggregation."""
    first = F.get("choices", F.lit(0))
    has = F.coalesce(first["reasoning"], F.lit("")) != ""
    rows = chunks.where("response_id is not null and seq is not null").groupBy("response_id", "seq").agg(F.max(F.struct(F.coalesce(first["reasoning"], F.lit("")).alias("r"), F.when(has, "").otherwise(F.coalesce(first["content"], F.lit(""))).alias("c"))).alias("x"), F.max(F.coalesce("last", F.lit(False))).alias("last"))
    told = rows.groupBy("response_id").agg(
        F.expr("listagg(x.r, '') within group (order by seq)").alias("reasoning"), F.expr("listagg(x.c, '') within group (order by seq)").alias("content"),
        F.count("*").alias("chunks"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end"),
    )
    return told.select("response_id", "reasoning", "content", "chunks", F.coalesce(F.col("chunks") >= F.col("end") + 1, F.lit(False)).alias("complete"))


def run(spark: SparkSession, path: str, out: str, checkpoint: str, patience: int = 600_000) -> None:
    """Fold the chunk files (JSON lines) that are new under ``path`` into ``out`` (Parquet) in one batch, and stop; state goes on at the next call.

    One batch, not a batch a wave of files until all are read: with timers, there would always be another batch to come.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = responses(spark.readStream.schema(CHUNK).json(path), patience)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
