"""Records that cross lines and splits, cut by many tasks: quoted CSV and JSON arrays.

A scan gives segments that end at a byte which may end a record: line breaks of CSV, closing braces of JSON. Whether one does depends on all that comes
before it in the file (an open quote, open brackets). So each split first tells what it does to any state it may begin in; summed up over a file's
splits, that gives the state in which each begins, and each task cuts its own records. A record that crosses splits is put together from pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.sources import scratch

#: What a row of cut records is: a whole record, the end of one, the inside of one (a split that ends none), the beginning of one; the
#: first whole record of a file.
WHOLE, END, INSIDE, BEGINNING, FIRST = range(5)
#: Bytes of segments that a task reads at a time, or one segment if that is longer: several copies of them exist while they are read.
RUN_BYTES = 1 << 20


@dataclass(frozen=True)
class Form:
    """How a format's segments are read: ``quotes`` counts those of each segment that open or close, ``levels`` gives by how much each segment
    and the separator after it change the depth. A record ends with a segment that leaves no quote open, at its file's base depth."""

    name: str
    separator: str

    def quotes(self, segments: pa.Array) -> np.ndarray:
        return pc.count_substring(self._plain(segments), '"').to_numpy(zero_copy_only=False).astype(np.int64)

    def levels(self, segments: pa.Array, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """``before``, ``after``: whether a quote is open there."""
        if self.name == "csv":
            return np.zeros(len(segments), np.int64)
        bare = pc.binary_join_element_wise(pc.if_else(pa.array(before), '"', ""), self._plain(segments), pc.if_else(pa.array(after), '"', ""), "")
        bare = pc.replace_substring_regex(bare, '"[^"]*"', "")
        count = lambda x: pc.count_substring(bare, x).to_numpy(zero_copy_only=False).astype(np.int64)
        return count("{") + count("[") - count("}") - count("]") - ~after

    def _plain(self, segments: pa.Array) -> pa.Array:
        """JSON has backslashes in strings only, so an escaped character can go without knowing where strings are."""
        return pc.replace_substring_regex(segments, r"\\.", "") if self.name == "json" else segments


CSV, JSON = Form("csv", "\n"), Form("json", "}")


def _segments(spark: SparkSession, path: str | list[str], form: Form) -> DataFrame:
    scan = spark.read.option("lineSep", form.separator).text(path)
    return scan.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of rows of one split, of about ``RUN_BYTES``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(1), batch.column(2)
        of = start.to_numpy()
        names = file.dictionary_encode().indices.to_numpy()
        run = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(), dtype=np.int64) // RUN_BYTES
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (names[1:] != names[:-1]) | (run[1:] != run[:-1])) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (file[a].as_py(), start[a].as_py()), batch.column(0).slice(a, b - a)


def _facts(form: Form):
    """A row a split: its quotes, its change of depth if it begins outside or inside of quotes, and of a file's first split how the file begins:
    the first record of CSV, the first character of JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quotes, depth, head, open_head = None, 0, [0, 0], [], True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "quotes": [quotes], "outside": [depth[0]], "inside": [depth[1]], "head": ["\n".join(head)]})

        for key, some in _by_split(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, quotes, depth, head, open_head = key, 0, [0, 0], [], key[1] == 0
            n = form.quotes(some)
            after = (quotes + np.cumsum(n)) & 1
            before = np.concatenate([[quotes & 1], after[:-1]])
            for state in (0, 1):
                depth[state] += int(form.levels(some, (before ^ state).astype(bool), (after ^ state).astype(bool)).sum())
            quotes += int(n.sum())
            if open_head:
                if form.name == "json":
                    head = [t for t in pc.utf8_slice_codeunits(pc.utf8_ltrim_whitespace(some), 0, 1).to_pylist() if t][:1]
                    open_head = not head
                else:
                    ends = np.flatnonzero(after == 0)
                    head += some.slice(0, int(ends[0]) + 1 if len(ends) else len(some)).to_pylist()
                    open_head = not len(ends)
        if now is not None:
            yield row()

    return run


def _states(facts: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int, int]], bool]:
    """(open quote, depth, base) where each split begins, of those where that isn't all zero: as many as the driver has splits at most. And
    whether a record crosses splits or is never closed."""
    file = Window.partitionBy("file").orderBy("start")
    until = file.rowsBetween(Window.unboundedPreceding, 0)
    told = facts.withColumn("odd", F.sum("quotes").over(until) % 2 == 1).withColumn("open", F.lag("odd", 1, False).over(file))
    told = told.withColumn("to", F.sum(F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))).over(until)).withColumn("depth", F.lag("to", 1, 0).over(file))
    told = told.withColumn("base", F.coalesce(F.max(F.when(F.col("start") == 0, (F.col("head") == "[").cast("int"))).over(Window.partitionBy("file")), F.lit(0)))
    # a file's last segment may have no separator, which is counted as if it had: an object ends at 0 or -1, an array at -1
    told = told.withColumn("crosses", F.when(F.col("start") > 0, F.col("open") | (F.col("depth") != F.col("base"))).otherwise(False) | (F.lead("start").over(file).isNull() & (F.col("odd") | ~F.col("to").isin(0, -1))))
    kept = told.where("open or depth <> 0 or base <> 0 or crosses").select("file", "start", "open", "depth", "base", "crosses")
    rows = list(kept.toLocalIterator())
    return {(r["file"], r["start"]): (r["open"], r["depth"], r["base"]) for r in rows}, any(r["crosses"] for r in rows)


def _cut(form: Form, states):
    """Rows (file, start, kind, record) of each split, in order."""
    sep = form.separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = states.value, None
        open_, depth, base, kind, pending = False, 0, 0, WHOLE, []

        def rows(what: int, found: pa.Array) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array([what] * n, pa.int32()), found.cast(pa.string())], names=["file", "start", "kind", "record"])

        def one(what: int, parts: list[str]) -> pa.RecordBatch:
            return rows(what, pa.array([sep.join(parts)]))

        def ended() -> Iterator[pa.RecordBatch]:
            if pending:
                yield one(INSIDE if kind == END else BEGINNING, pending)

        for key, some in _by_split(batches):
            if key != now:
                yield from ended()
                now, pending = key, []
                open_, depth, base = known.get(key, (False, 0, 0))
                kind = FIRST if key[1] == 0 else END if open_ or depth != base else WHOLE  # of the first record that ends here
            after = ((int(open_) + np.cumsum(form.quotes(some))) & 1).astype(bool)
            level = depth + np.cumsum(form.levels(some, np.concatenate([[open_], after[:-1]]), after))
            open_, depth = bool(after[-1]), int(level[-1])
            ends = np.flatnonzero(~after & (level == base))
            if not len(ends):
                pending += some.to_pylist()
                continue
            yield one(kind, pending + some.slice(0, int(ends[0]) + 1).to_pylist())
            kind = WHOLE
            if len(ends) > 1:
                yield rows(WHOLE, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends + 1, pa.int32()), some), sep))
            pending = some.slice(int(ends[-1]) + 1).to_pylist()
        yield from ended()

    return run


def _records(spark: SparkSession, path: str | list[str], form: Form) -> tuple[DataFrame, DataFrame]:
    """Records (column ``record``) of all files but the first ones of CSV files, and a row a split with how its file begins.

    Files are read once for states, once for records, and once more only if a record crosses splits; nothing but the pieces of those that do is
    moved, and a record's pieces meet in one task.
    """
    scan = _segments(spark, path, form)
    with scratch.small_batches(spark):
        facts = scratch.written(scan.mapInArrow(_facts(form), "file string, start long, quotes long, outside long, inside long, head string"), "splits")
    states, crossing = _states(facts)
    cut = scan.mapInArrow(_cut(form, spark.sparkContext.broadcast(states)), "file string, start long, kind int, record string")
    whole = cut.where(F.col("kind") == WHOLE if form is CSV else F.col("kind").isin(WHOLE, FIRST)).select("record")
    if crossing:
        pieces = scratch.written(cut.where(F.col("kind").isin(END, INSIDE, BEGINNING)), "pieces")
        order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
        numbered = pieces.withColumn("of", F.sum((F.col("kind") == BEGINNING).cast("int")).over(order))
        joined = numbered.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
        whole = whole.union(joined.select(F.array_join(F.transform("parts", lambda p: p["record"]), form.separator).alias("record")))
    return whole, facts


def _strings(records: DataFrame):
    """The records as what Spark's own parsers take: a data set of strings."""
    return getattr(records._jdf, "as")(records.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def csv(spark: SparkSession, path: str | list[str], schema=None, infer: bool = True) -> DataFrame:
    """CSV with a header a file, quoted fields over several lines, doubled quotes, read by as many tasks as there are splits.

    A quote in a field that isn't quoted, which the format doesn't allow, would mislead the cut. A header must end in its file's first split. Columns are those
    of ``schema`` by position, else named by the header of the first file, with inferred types (a further pass) or as text.
    """
    rows, facts = _records(spark, path, CSV)
    head = facts.where("start = 0").orderBy("file").select("head").first()
    if head is None or not head["head"].strip():
        return spark.createDataFrame([], schema or "value string").limit(0) if schema else spark.range(0).select()
    rows = rows.select(F.regexp_replace("record", r"\r\z", "").alias("record"))
    reader = spark.read.option("escape", '"').option("multiLine", True)
    if schema is None:
        named = DataFrame(reader._jreader.csv(_strings(spark.createDataFrame([(head["head"].rstrip("\r"),)], "record string"))), spark).first()
        names = [f"_c{i}" if n is None else n for i, n in enumerate(named)]
        types = DataFrame(reader.option("inferSchema", True)._jreader.csv(_strings(rows)), spark).schema if infer else None
        kinds = [types[i].dataType.simpleString() if types is not None and i < len(types) else "string" for i in range(len(names))]
        schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(_distinct(names), kinds, strict=True))
    reader = spark.read.option("escape", '"').option("multiLine", True).schema(schema)
    return DataFrame(reader._jreader.csv(_strings(rows)), spark)


def _distinct(names: list[str]) -> list[str]:
    """Repeated names get their place behind them."""
    low = [n.lower() for n in names]
    return [f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def json_array(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Objects of files that are one array of objects each, or objects one after the other, read by as many tasks as there are splits. What isn't one fails the query."""
    rows, _ = _records(spark, path, JSON)
    rows = rows.select(F.regexp_replace("record", r"\A\s*[\[,]?\s*", "").alias("record"))
    # a whole record has lost the brace that ended it; what comes after a file's last one is the end of its array
    objects = rows.where(~F.col("record").rlike(r"\A\s*\]?\s*\z")).select(F.when(F.col("record").startswith("{"), F.concat("record", F.lit("}"))).otherwise(F.col("record")).alias("record"))
    reader = spark.read.option("mode", "FAILFAST")
    return DataFrame((reader.schema(schema) if schema else reader)._jreader.json(_strings(objects)), spark)
