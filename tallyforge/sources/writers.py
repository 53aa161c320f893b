"""Sinks: CSV, JSON lines, JSON arrays, log lines, split tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tallyforge.functions.text import with_suffix
from tallyforge.sources import arrow, scratch
from tallyforge.sources.readers import COMMITS, MANIFEST, ROWS


def csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header; arrays as JSON text, which CSV can hold."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat = df.withColumns({n: F.to_json(n) for n in nested}) if nested else df
    flat.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, append: bool = False, order: str | None = None) -> None:
    """One object a line, raw Unicode, nulls written. With ``order``, lines ascend by that column over all files in order of name."""
    df = df if order is None else df.orderBy(order)
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def int_array(df: DataFrame, column: str, path: str) -> None:
    """One file with the ascending values as a JSON array. The array is one value, so it is for short lists such as error indices."""
    df.agg(F.to_json(F.array_sort(F.collect_list(column))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def log_lines(df: DataFrame, line: Column, path: str, append: bool = True) -> None:
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def output_of(source: Column, root: str = "") -> Column:
    """The name of a source's output: its path below ``root``, with ``_filtered`` before the extension."""
    return with_suffix(F.regexp_replace(source, f"^{re.escape(root)}/*", "") if root else source)


def by_source(df: DataFrame, path: str, source: str = "source_file", root: str = "") -> None:
    """JSON lines in a folder a source, named by ``output_of``: sources of one base name in two folders stay apart. A source without rows gets none."""
    df.withColumn("output", output_of(F.col(source), root)).drop(source).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("output").json(path)


def splits(df: DataFrame, path: str, column: str = "split", names: tuple[str, ...] = ()) -> None:
    """Parquet by split; reading one split opens its files only. ``names`` are splits that count as written also without rows.

    A manifest of splits and rows is written last, from counts that the write itself takes, and the one of an earlier write goes first: a
    write that fails leaves none, so ``readers.cached`` doesn't take its files for the whole.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    df.write.mode("overwrite").partitionBy(column).parquet(f"{path}/data")
    rest = df.drop(column).schema.json()
    written = spark.read.schema(df.schema).parquet(f"{path}/data").groupBy(F.col(column).cast("string").alias("split")).agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([(n,) for n in names], "split string").join(written, "split", "full").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.lit(column).alias("column"), F.lit(rest).alias("kind"))
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch as JSON lines, unless it was before; whether they were. ``readers.appended`` reads the table.

    An attempt writes to a folder of its own and is committed by one small file, created only if the batch has none yet. So a batch that is
    tried again after a crash, or twice at once, counts once, and what a failed attempt left doesn't count. Fit for ``foreachBatch``.
    """
    spark = df.sparkSession
    name = re.sub(r"[^0-9A-Za-z_.-]", lambda m: f"%{ord(m[0]):x}", batch)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/{name}.json")
    system = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(mark):
        return False
    attempt, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(f"{path}/{ROWS}/attempt={attempt}")
    try:
        out = system.create(mark, False)
    except Exception:
        if system.exists(mark):  # another attempt was first
            return False
        raise
    out.write(bytearray((json.dumps({"batch": batch, "attempt": attempt, "n": seen.get["n"]}) + "\n").encode()))
    out.close()
    return True


def filtered(df: DataFrame, keep: Column, path: str, bad: Column | None = None) -> dict[str, int]:
    """Write the rows that ``keep`` holds for as JSON lines; total, kept, discarded and bad, counted by the pass that writes.

    ``bad`` marks rows of lines that couldn't be read: they count in the total, but are neither kept nor discarded.
    """
    wrong = F.coalesce(bad, F.lit(False)) if bad is not None else F.lit(False)
    kept = ~wrong & F.coalesce(keep, F.lit(False))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~wrong & ~kept).alias("discarded"), F.count_if(wrong).alias("bad")]
    df.observe(seen, *counts).where(kept).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get


def arrow_files(df: DataFrame, path: str) -> None:
    """Arrow IPC files in a folder, one a task, in record batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows."""
    df.sparkSession.dataSource.register(arrow.ArrowSource)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(at).toString()
    df.write.format(arrow.ArrowSource.name()).mode("append").save(arrow.uri_of(uri))


def json_array(df: DataFrame, path: str) -> None:
    """Files that are one array of objects each, one a task."""

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for part in parts:
            if part.num_rows:
                marks = pa.array([before] + [","] * (part.num_rows - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, part.column(0), " ")], ["value"])
                before = ","
        if before == ",":
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    objects = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    with scratch.small_batches(df.sparkSession):
        objects.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def dump(df: DataFrame, path: str, kind: str = "jsonl") -> None:
    writers = {"jsonl": json_lines, "json": json_array, "csv": csv, "arrow": arrow_files, "parquet": lambda d, p: d.write.mode("overwrite").parquet(p)}
    if kind not in writers:
        raise ValueError(f"no writer for {kind!r}")
    writers[kind](df, path)
