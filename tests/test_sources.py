"""Readers and writers, with bad lines, odd files and round trips."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tallyforge.sources import readers, scratch, writers
from tallyforge.streaming.ingest import follow

SCHEMA = "a int, b string"


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    return str(p)


def test_bad_lines(spark, lines):
    assert readers.json_lines(spark, lines, SCHEMA, "skip").select("a", "b").where("a is not null").count() == 2
    kept = readers.json_lines(spark, lines, SCHEMA, "keep").cache()
    assert kept.count() == 3 and kept.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        readers.json_lines(spark, lines, SCHEMA).collect()
    with pytest.raises(ValueError):
        readers.json_lines(spark, lines, SCHEMA, "?")


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "o.json").write_text('{"a": 3}')
    assert readers.json_array(spark, [str(tmp_path / "a.json"), str(tmp_path / "o.json")], SCHEMA).count() == 3
    assert readers.load(spark, str(tmp_path / "a.json")).count() == 2


def test_json_array_is_written_in_small_batches(spark, tmp_path, monkeypatch):
    key, seen, text = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (seen.append(spark.conf.get(key)), text(self, *a, **k))[1])
    before = spark.conf.get(key)
    writers.json_array(spark.range(0, 2500, 1, 2).select("id", F.lit("é\n").alias("t")), str(tmp_path / "x"))
    assert seen == ["1000"] and spark.conf.get(key) == before
    files = [json.loads(p.read_text(encoding="utf-8")) for p in sorted((tmp_path / "x").glob("part-*"))]
    assert files == [[{"id": i, "t": "é\n"} for i in range(*some)] for some in ((1250,), (1250, 2500))]
    writers.json_array(spark.range(3).where("id > 5"), str(tmp_path / "none"))
    assert not "".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('q,n\n"a ""b""\nc",1\n', encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "x.csv")).first().asDict() == {"q": 'a "b"\nc', "n": 1}
    assert readers.csv_strings(spark, str(tmp_path / "x.csv")).first()["n"] == "1"


def test_row_ids_follow_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    got = readers.text_lines(spark, str(tmp_path / "*.txt")).orderBy("row_id").collect()
    assert [(r["row_id"], r["value"]) for r in got] == list(enumerate(["a0", "a1", "a2", "b0", "b1"]))
    assert readers.whole_text(spark, str(tmp_path / "b.txt")).first()["value"] == "b0\nb1"


def test_union_scan(spark, lines, tmp_path):
    got = readers.union_scan(spark, f"{lines}, {tmp_path}/none.jsonl", SCHEMA).where("a is not null")
    assert got.count() == 2 and got.first()["source_file"].endswith("x.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.union_scan(spark, [f"{tmp_path}/none.jsonl"], SCHEMA, missing_ok=False)
    assert readers.union_scan(spark, f"{tmp_path}/none.jsonl", SCHEMA).count() == 0


def test_arrow_and_parquet(spark, tmp_path):
    table = pa.table({"a": [1, 2]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert readers.load(spark, str(tmp_path / "x.arrow")).count() == readers.columnar(spark, str(tmp_path / "x.arrow")).count() == 2
    (tmp_path / "d").mkdir()
    for name, opened in (("b.arrow", pa.ipc.new_stream), ("a.arrow", pa.ipc.new_file)):
        with pa.OSFile(str(tmp_path / "d" / name), "wb") as f, opened(f, table.schema) as w:
            w.write_table(table)
            w.write_table(table)
    (tmp_path / "d" / "state.json").write_text("{}")
    for read in (readers.columnar, readers.arrow_files):
        assert sorted(r["a"] for r in read(spark, str(tmp_path / "d")).collect()) == [1, 1, 1, 1, 2, 2, 2, 2]
    with pytest.raises(FileNotFoundError):
        readers.columnar(spark, str(tmp_path / "nothing"))
    (tmp_path / "bad.parquet").write_bytes(b"neither of them")
    with pytest.raises(Exception, match="(?i)arrow|invalid|metadata"):
        readers.columnar(spark, str(tmp_path / "bad.parquet")).collect()
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.columnar(spark, str(tmp_path / "p")).count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.folder(Session, "x")


def test_cleared(spark):
    """A block's own tables go, also when it fails; those of outer blocks, of other threads and of no block stay."""
    from concurrent.futures import ThreadPoolExecutor
    from pathlib import Path

    def made(label):
        rows = scratch.written(spark.range(3), label)
        assert rows.count() == 3
        return next(Path(scratch.shared(spark).removeprefix("file://")).glob(f"*/{label}-*"))

    free = made("free")
    with scratch.cleared(spark):
        outer = made("outer")
        with pytest.raises(KeyError), scratch.cleared(spark):
            inner = made("inner")
            with ThreadPoolExecutor(1) as other:
                elsewhere = other.submit(made, "elsewhere").result()
            raise KeyError
        assert not inner.exists() and outer.exists()
    assert not outer.exists() and free.exists() and elsewhere.exists()


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, "b", "c")], "n long, s string, t string")
    writers.json_lines(rows, str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("*.json"))
    assert "é" in text and '"t":null' in text
    writers.int_array(rows, "n", str(tmp_path / "i"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "i").glob("part*"))) == [1, 2]
    writers.csv(rows.withColumn("x", F.array("n")), str(tmp_path / "c"))
    assert readers.csv_strings(spark, str(tmp_path / "c")).where("x = '[2]'").count() == 1
    writers.by_source(rows.withColumn("source_file", F.lit("d/in.jsonl")), str(tmp_path / "s"), root="d")
    assert (tmp_path / "s" / "output=in_filtered.jsonl").is_dir()
    writers.log_lines(rows, F.col("s"), str(tmp_path / "l"))
    writers.log_lines(rows, F.col("s"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4
    writers.splits(rows.withColumn("split", F.when(F.col("n") == 1, "train").otherwise("val")), str(tmp_path / "p"))
    assert readers.cached(spark, str(tmp_path / "p")) is None and readers.cached(spark, str(tmp_path / "p"), ("train", "val"))["val"].count() == 1
    with pytest.raises(ValueError):
        writers.dump(rows, "x", "?")


def test_following_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1, "b": "x"}\n')
    for n in (1, 2):
        follow(spark, str(tmp_path / "in"), SCHEMA, lambda d: d.withColumn("c", F.col("a") + 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.json").write_text('{"a": 2, "b": "y"}\n')


def test_row_ids_over_many_splits(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.text_lines(spark, str(tmp_path / "*.txt")).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["row_id"], r["value"]) for r in got] == list(enumerate(f"{n} line {i}" for n in "ab" for i in range(3000)))
