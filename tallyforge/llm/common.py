"""What the operators of this subpackage share: columns by exact name, shared storage, components, gapless ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from tallyforge.sources import scratch
from tallyforge.sources.scratch import small_batches  # noqa: F401

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact case, so that extra columns such as ``TEXT`` beside ``text`` don't clash."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def contents(rows: DataFrame) -> list[Column]:
    """What tells two rows apart, for a hash: each column and whether it is null (a null leaves a hash as it is); maps and variants as JSON."""
    told = [F.to_json(F.col(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in rows.dtypes if kind != "void"]
    return [x for c in told for x in (c, c.isNull())]


class Carried:
    """All columns of a table under names of our own, to be given their old names back after a stage has decided.

    ``rows`` has columns ``_c0, _c1, ...``; ``col(name)`` finds one by its exact old name.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.rows = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])

    def col(self, name: str) -> Column:
        return F.col(f"_c{self.names.index(name)}")

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[f"_c{i}" for i in range(len(self.names))]).toDF(*self.names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one of a local master (tests).

    Another master without that setting raises: its executors' own disks would each keep a part of a table.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not scratch.is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tallyforge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def materialize(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives lost executors.

    A ``small`` one (sums, thresholds) is written as no more files than there are cores; nothing is shuffled for that.

    Files lie under ``<shared>/<application id>/`` and go with that folder when the application's data is cleared, or see ``scratch.cleared``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if small:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    df.write.option("compression", "zstd").parquet(path)
    scratch.note(path)
    return spark.read.schema(df.schema).parquet(path)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs, each from about ``size`` bytes, so that a very long text isn't a list of all its words at once."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield (text if not at and end == len(text) else text[at:end]).split()
        at = end


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, least): the least v of each u.

    The least values carry the key as an expression, so the join needs an exchange on both sides; adaptive execution can
    then split a node that holds a large part of all pairs.
    """
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("least"))
    return pairs.join(least, pairs["u"] == least["k"].bitwiseXOR(F.lit(0)))


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes (long) of an edge list (first two columns) with the smallest node that each can reach.

    Alternating large-star and small-star steps; each makes star forests with the smallest node in the middle, in a
    number of rounds that grows with the logarithm of the longest chain. Nodes without an edge to another one, and
    null nodes, aren't returned. Returns (node long, component long), one row a node; no rows for no edges. Each step's links are
    written, so lost executors cost no lineage, and go with the operator's other tables (``scratch.cleared``), as checkpoint files don't.
    """
    a, b = edges.columns[:2]
    e = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        large = materialize(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct(), "links-large")
        small = _with_least(large)
        e = materialize(small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct(), "links-small")
        now = state(e)
        if now == before:
            break
        before = now
    middle = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(middle)


def hashed(seed: int, *parts: Column) -> Column:
    """60 bits of the MD5 of ``<part>:<part>: ... :<seed>`` as a long, which any engine can repeat; a null part counts as ``null``."""
    told = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *told, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def with_copy(rows: DataFrame, alike: str = "alike", place: str = "place", out: str = "copy") -> DataFrame:
    """Number rows of one ``alike`` (a hash of what makes rows interchangeable) from 0 without gaps, however many there are.

    ``rows`` is a written table whose ``place`` was ``monotonically_increasing_id()`` when it was written: its upper bits tell the writing task.
    Counts by value and task give each task's first number, so rows of one value are numbered by as many tasks as wrote them. Only
    rows of repeated values are moved.
    """
    again = materialize(rows.groupBy(F.col(alike).alias("_a")).agg(F.count("*").alias("_n")).where("_n > 1").select("_a"), "copies", small=True)
    if again.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("long"))
    task = F.shiftright(F.col(place), 33)
    some = rows.join(again, rows[alike] == again["_a"], "left_semi").select(F.col(alike).alias("_v"), F.col(place).alias("_p"), task.alias("_t"))
    count = some.groupBy(F.col("_v").alias("_cv"), F.col("_t").alias("_ct")).agg(F.count("*").alias("_n"))
    first = count.select("_cv", "_ct", (F.sum("_n").over(Window.partitionBy("_cv").orderBy("_ct").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("_v", "_t").orderBy("_p")))
    numbers = materialize(ranked.join(first, (F.col("_v") == F.col("_cv")) & (F.col("_t") == F.col("_ct"))).select("_p", (F.col("_first") + F.col("_r") - 1).alias("_copy")), "copy-numbers")
    joined = rows.join(numbers, rows[place] == numbers["_p"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_copy"), F.lit(0)).cast("long")).drop("_p", "_copy")


#: Leading bits of an order that deal rows to cells.
_CELL_BITS = 20


def gapless_rank(df: DataFrame, group: str, order: str, bits: int, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in order of a hash (a long below 2**bits), without gathering a group in one task.

    The hash's range is cut into P equal cells, P the number of shuffle partitions; counts of cells, of which there are groups x P,
    give each cell's first number. The numbers don't depend on P. ``df`` is read twice: give a materialized table.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = df.withColumn("_cell", F.shiftright(F.shiftright(F.col(order), bits - _CELL_BITS) * F.lit(parts), _CELL_BITS))
    count = cells.groupBy(F.col(group).alias("_g"), F.col("_cell").alias("_k")).agg(F.count("*").alias("_n"))
    first = count.select("_g", "_k", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    ranked = cells.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(order, *ties)))
    joined = ranked.join(first, (ranked[group] == first["_g"]) & (ranked["_cell"] == first["_k"]))
    return joined.withColumn(out, (F.col("_first") + F.col("_rn") - 1).cast("long")).drop("_cell", "_g", "_k", "_first", "_rn")


def streamed_groups(batches: Iterator, keys: tuple[str, ...]) -> Iterator[tuple[tuple, "object", bool]]:
    """Split sorted pandas batches at changes of the keys: (key, rows of this batch with it, whether the key begins here)."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[list(keys)].ne(pdf[list(keys)].shift())).any(axis=1).to_numpy()
        change[0] = True
        starts = change.nonzero()[0].tolist()
        for s, t in zip(starts, [*starts[1:], len(pdf)], strict=True):
            key = tuple(pdf[k].iat[s] for k in keys)
            yield key, pdf.iloc[s:t], key != last
            last = key


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
