"""The Merkle manifest against a plain tree in Python and against SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import op11_merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, arity):
    """The root, and for each leaf its steps (before, after)."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a - a % arity : a - a % arity + arity]
            steps[i].append("".join(run[: a % arity]) + "|" + "".join(run[a % arity + 1 :]))
        level, at = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [a // arity for a in at]
    return level[0], steps


def plain_manifest(rows, arity=3):
    """(doc_id, source, idx, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    by = {}
    for k, text, lang, source, n in rows:
        by.setdefault(source, []).append(((k is not None, k or 0), h(*map(told, (k, source, lang, n, text))), k))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([d for _, d, _ in sorted(by[s], key=lambda x: x[:2])], arity) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops):
        for i, ((_, d, k), steps) in enumerate(zip(sorted(by[s], key=lambda x: x[:2]), trees[s][1])):
            out.append((k, s, i, d, trees[s][0], root, steps + top))
    return out


def same(got, want):
    assert sorted(map(repr, [(r["doc_id"], r["source"], r["idx"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got])) == sorted(map(repr, want))


@pytest.mark.parametrize(("arity", "height"), [(3, 10), (3, 1), (2, 2), (5, 3)])
def test_manifest_against_a_plain_tree(spark, arity, height):
    rng = random.Random(arity)
    rows = [(i * 7, "x" * rng.randrange(9), "en", rng.choice(["hot"] * 12 + ["a", "b", None, "é", "Z"]), i) for i in range(400)] + [(9000, "alone", "de", "single", 5)]
    rng.shuffle(rows)
    same(op11_merkle.manifest(spark.createDataFrame(rows, DOCS), arity=arity, height=height).collect(), plain_manifest(rows, arity))


def test_many_sources_and_one_source(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 90}", 1) for i in range(200)]
    same(op11_merkle.manifest(spark.createDataFrame(rows, DOCS), height=2).collect(), plain_manifest(rows))
    rows = [(i, f"t{i}", "en", "one", 1) for i in range(100)]
    same(op11_merkle.manifest(spark.createDataFrame(rows, DOCS), height=2).collect(), plain_manifest(rows))


def test_odd_rows(spark):
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t", "en", "", 3), (3, "wörd " * 60_000, "en", "a", 300_000), (5, "same", "de", "b", 4), (5, "same", "de", "b", 4), (5, "other", "de", "b", 4), (None, "no key", "fr", "b", 6), (None, "no key", "fr", "b", 6), (-7, "☃ 𝒳", "fr", "a", 3)]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(v).alias(n) for n, v in {"TEXT": "x", "tree": 1, "idx": 2, "k": 0, "n": 5, "leaf": "y", "_0": 9}.items()])
    got = op11_merkle.manifest(df)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    same(got.collect(), plain_manifest(rows))
    assert op11_merkle.manifest(df.limit(0)).collect() == []
    one = op11_merkle.manifest(df.where("doc_id = 1")).collect()
    assert [(r["leaf"] == r["subroot"] == r["root"], r["proof"]) for r in one] == [(True, [])]


def test_repeated_rows_may_be_a_third(spark):
    rows = [(1, "again", "en", "s", 5)] * 300 + [(i, f"t{i}", "en", "s", 2) for i in range(2, 500)]
    same(op11_merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(7), height=3).collect(), plain_manifest(rows))


def test_parents_close_once_they_are_whole():
    tree = op11_merkle.Tree(11, 3)
    order = list(range(11))
    random.Random(1).shuffle(order)
    for i in order:
        tree.add(0, i, h(str(i)))
    assert not tree.open and tree.frontier() == [(3, 0, plain_tree([h(str(i)) for i in range(11)], 3)[0])]
    part = op11_merkle.Tree(11, 3)
    for i in (2, 3, 4, 5, 9, 10):
        part.add(0, i, h(str(i)))
    assert sorted((level, at) for level, at, _ in part.frontier()) == [(0, 2), (1, 1), (2, 1)]


def test_query_tells_tampered_rows(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    got = op11_merkle.query(spark, at)
    duckdb.sql(f"create or replace view documents as select * from '{at}/documents.parquet'")
    want = duckdb.sql(op11_merkle.sql())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for r in got.collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 != 0 or "\n" not in texts[r["doc_id"]])
