"""Scans of CSV, JSON lines, JSON arrays, text, Parquet and Arrow files, with line ordinals where a query needs them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from tallyforge.functions import records
from tallyforge.sources import arrow, scratch, splitting

Schema = T.StructType | str
CORRUPT = "_corrupt_record"
#: Folder of what a finished write of splits states about itself.
MANIFEST = "manifest"


def paths(text: str | Iterable[str]) -> list[str]:
    """Paths of a comma-separated list or an iterable, without blanks; globs stay for Spark to expand."""
    parts = text.split(",") if isinstance(text, str) else text
    return [p.strip() for p in parts if p.strip()]


def existing(spark: SparkSession, candidates: Iterable[str]) -> list[str]:
    """Those paths or globs that match something in their own file system."""
    found = []
    for path in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        if matches is not None and len(matches):
            found.append(path)
    return found


def csv(spark: SparkSession, path: str | list[str], schema: Schema | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines, doubled quotes, read in splits. Without a schema, types are inferred (another pass)."""
    return splitting.csv(spark, path, schema)


def csv_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every field as text, read in splits."""
    return splitting.csv(spark, path, infer=False)


def json_lines(spark: SparkSession, path: str | list[str], schema: Schema, bad: str = "fail") -> DataFrame:
    """JSON lines; blank ones don't count. ``bad`` lines: ``fail`` the query, ``skip``, or ``keep`` as rows with ``_corrupt_record``."""
    if bad == "keep":
        fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if CORRUPT not in fields.names:
            fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    modes = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}
    if bad not in modes:
        raise ValueError(f"bad is fail, skip or keep, not {bad}")
    return spark.read.schema(schema).option("mode", modes[bad]).json(path)


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines of any shapes: value (the line) and record (``VARIANT``, null for a line that isn't JSON), blank lines left out. See ``functions.records``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", records.parsed(F.col("value")).alias("record"))


def json_array(spark: SparkSession, path: str | list[str], schema: Schema | None = None) -> DataFrame:
    """Files that are one array of objects each, or objects one after the other, read in splits; anything else fails. Without a schema, it is inferred (another pass)."""
    return splitting.json_array(spark, path, schema)


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, row_id (from 0 over all files in order of path), value."""
    return with_row_id(spark.read.text(path))


def whole_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file: its text without white space at the ends."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))


def parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*paths(path))


#: Fixed value: how Parquet files begin.
PARQUET_MAGIC = b"PAR1"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files with data of a path or glob, by name: itself, or those in a folder that aren't hidden."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in system.globStatus(at) or []:
        inside = system.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [f.getPath().toString() for f in inside if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"]
    return sorted(out)


def arrow_files(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Arrow IPC files or streams: single ones, those of globs, or all ``*.arrow`` of folders (all files of a folder that has none).

    A few record batches are a partition, planned from the files' footers, so a file of any size is read by many tasks; a stream, which has no
    footer, by one, batch by batch. Only ``columns`` are decoded. All files must have one schema.
    """
    spark.dataSource.register(arrow.ArrowSource)
    uris = []
    for one in paths(path):
        found = _files(spark, one)
        uris += [f for f in found if f.endswith(".arrow")] or found
    if not uris:
        raise FileNotFoundError(f"no Arrow file at {path}")
    reader = spark.read.format(arrow.ArrowSource.name()).option("uris", json.dumps([arrow.uri_of(u) for u in uris]))
    return (reader if columns is None else reader.option("columns", json.dumps(columns))).load()


def first_bytes(spark: SparkSession, path: str, n: int = 6) -> bytes:
    """The first bytes of the file, or of the first one with data in the folder or glob."""
    found = _files(spark, path)
    if not found:
        raise FileNotFoundError(f"no file with data at {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(found[0])
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def columnar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet or Arrow, told path by path by how the first file begins; what isn't Parquet is read as Arrow, and fails if it isn't."""
    wanted = paths(path)
    of_parquet = [p for p in wanted if existing(spark, [f"{p}/*=*"]) or first_bytes(spark, p).startswith(PARQUET_MAGIC)]
    parts = [read(spark, some) for read, some in ((parquet, of_parquet), (arrow_files, [p for p in wanted if p not in of_parquet])) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def load(spark: SparkSession, path: str | list[str], schema: Schema | None = None, kind: str | None = None, bad: str = "fail") -> DataFrame:
    """One entry for all formats, by ``kind`` or the (first) path's extension: csv, jsonl, json (an array), txt, parquet, arrow. All of a list of paths count."""
    first = path if isinstance(path, str) else path[0]
    kind = kind or {"ndjson": "jsonl", "text": "txt"}.get(ext := first.rstrip("/*").rpartition(".")[2].lower(), ext)
    if kind == "csv":
        return csv(spark, path, schema)
    if kind == "jsonl":
        return json_lines(spark, path, schema or spark.read.json(path).schema, bad)
    if kind == "json":
        return json_array(spark, path, schema)
    if kind == "txt":
        return text_lines(spark, path)
    if kind == "arrow":
        return arrow_files(spark, path)
    if kind == "parquet":
        return columnar(spark, path)
    raise ValueError(f"no reader for {kind!r}")


def union_scan(spark: SparkSession, listed: str | Iterable[str], schema: Schema, bad: str = "skip", missing_ok: bool = True) -> DataFrame:
    """JSON lines of all listed paths and globs with ``source_file``; missing ones are left out, or raise FileNotFoundError."""
    wanted = paths(listed)
    there = existing(spark, wanted)
    if not missing_ok and len(there) < len(wanted):
        raise FileNotFoundError(", ".join(sorted(set(wanted) - set(there))))
    if not there:
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit(None).cast("string"))
    return json_lines(spark, there, schema, bad).withColumn("source_file", F.col("_metadata.file_path"))


def with_row_id(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """A file scan with ``file`` and row numbers from 0, in order of path and place in the file.

    Rows are written once with their file, split and a number that ascends within a task. Counts by split (a row a split), of these same
    rows, are summed up and written, and each row adds its place in its split. The counts are read back with a known size, so
    Spark broadcasts them only where that is small.
    """
    place = ["file", "_start"]
    rows = scratch.written(scan.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")), "rows")
    split = rows.groupBy(*place).agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = F.sum("_n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return rows.join(scratch.written(split.withColumn("_before", before), "row-ids"), place).withColumn(name, F.col("_before") + F.col("_id") - F.col("_low")).drop("_start", "_id", "_n", "_low", "_before")


#: Data sets by name: path, schema and kind, for queries that name their input.
DATASETS: dict[str, tuple[str, Schema | None, str | None]] = {}


def dataset(spark: SparkSession, name: str, split: str | None = None) -> DataFrame:
    """A registered data set, or a table of that name; ``split`` keeps that value of the column ``split``."""
    rows = load(spark, *DATASETS[name]) if name in DATASETS else spark.table(name)
    return rows.where(F.col("split") == split) if split else rows


def cached(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "val", "test")) -> dict[str, DataFrame] | None:
    """Split tables that ``writers.splits`` wrote, if it finished and all are there; a split without rows is an empty table.

    The manifest, written last, names the splits and their rows; what a write that failed has left has none and doesn't count.
    """
    if not existing(spark, [f"{path}/{MANIFEST}/_SUCCESS"]):
        return None
    listed = {r["split"]: r["n"] for r in spark.read.schema("split string, n long, column string, kind string").json(f"{path}/{MANIFEST}").collect()}
    if not set(names) <= set(listed):
        return None
    about = spark.read.schema("split string, n long, column string, kind string").json(f"{path}/{MANIFEST}").first()
    empty = spark.createDataFrame([], T.StructType.fromJson(json.loads(about["kind"])))
    return {n: spark.read.schema(empty.schema).parquet(f"{path}/data/{about['column']}={n}") if listed[n] else empty for n in names}


#: Folders of what an appended table holds: rows by batch, and a mark for each batch that was written to its end.
ROWS, COMMITS = "rows", "commits"


def appended(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Rows that ``writers.append_once`` wrote, with ``batch``, each batch once: only files count whose batch was committed, by the attempt that was."""
    if not existing(spark, [f"{path}/{COMMITS}/*"]):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    done = spark.read.schema("batch string, attempt string, n long").json(f"{path}/{COMMITS}")
    # as many paths as there are batches with rows, which the driver lists anyway
    at = [f"{path}/{ROWS}/attempt={r['attempt']}" for r in done.where("n > 0").collect()]
    if not at:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).option("basePath", f"{path}/{ROWS}").json(at).withColumn("_attempt", F.regexp_extract(F.col("_metadata.file_path"), "attempt=([0-9a-f]+)", 1))
    return rows.drop("attempt").join(done.select(F.col("attempt").alias("_attempt"), "batch"), "_attempt").drop("_attempt")
