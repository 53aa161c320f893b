"""Calls to a service that outlive the run that makes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.functions.external import remote_map
from tallyforge.sources import readers, writers


def mapped_once(rows: DataFrame, key: str, prompt: str, call: Callable[[str], str], path: str, steps: int = 16, again: bool = False, **how: int) -> DataFrame:
    """``remote_map`` of rows whose ``key`` tells them apart, with a ledger under ``path``: rows that it has aren't asked again.

    Rows are dealt to ``steps`` steps by a hash of their key; each step's rows that the ledger lacks are asked and appended in one write (at most once, see
    ``writers.append_once``). A run that is killed loses the step that it was in, and the next one goes on from there, also with rows that are
    new. With ``again``, rows whose last answer was an error are asked anew. Returns the ledger's last row of each key of ``rows``.
    """
    spark = rows.sparkSession
    fields = T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in ("user_content", "response", "error")), T.StructField("run", T.LongType())])
    ledger = lambda: readers.appended(spark, path, fields)
    run = 1 + (ledger().agg(F.max("run")).first()[0] or 0)
    step = F.pmod(F.xxhash64(key), F.lit(steps))
    for k in range(steps):
        known = ledger()
        if again:
            known = known.groupBy(key).agg(F.max_by("error", "run").alias("error")).where("error is null")
        todo = rows.where(step == k).join(known.select(key), key, "left_anti")
        if todo.isEmpty():
            continue
        writers.append_once(remote_map(todo, prompt, call, **how).withColumn("run", F.lit(run).cast("long")), path, f"{run}-{k}")
    last = ledger().groupBy(key).agg(F.max_by(F.struct(*[f.name for f in fields if f.name not in (key, "run")]), "run").alias("_row")).select(key, "_row.*")
    return last.join(rows.select(key), key, "left_semi").select(*[f.name for f in fields if f.name != "run"])
