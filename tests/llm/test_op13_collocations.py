"""Collocations against plain counts in Python and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import op13_collocations as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or ""))]


def plain_counts(texts, longest=4):
    out = Counter()
    for text in texts:
        for words in pieces(text):
            for m in range(1, longest + 1):
                out.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return out


def plain(rows, longest=4, min_count=30, share=80, top=2000):
    out, by = [], {}
    for text, lang in rows:
        by.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by.items():
        f = plain_counts(texts, longest)
        n = sum(k for p, k in f.items() if len(p) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        hidden = Counter()
        for q, a in some.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    hidden[q[i : i + m]] = max(hidden[q[i : i + m]], a)
        found = []
        for p, a in some.items():
            if 100 * hidden[p] >= share * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["New", "york", "city", "HALL", "the", "a", "of", "é", "Ünï", "\x00x", "don't", "x y"]
    fixed = ["new york city hall", "a of the", "of the a of"]
    rows = []
    for _ in range(n):
        text = "".join((rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed)) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("width", "depth", "min_count"), [(1 << 16, 2, 5), (1 << 5, 2, 5), (1 << 12, 3, 300), (1 << 12, 1, 3)])
def test_collocations_against_plain_counts(spark, width, depth, min_count):
    """Also where nearly all phrases share their cells, and where counts pass a byte."""
    rows = made(width)
    got = op13.collocations(table(spark, rows).repartition(5), min_count=min_count, width=width, depth=depth)
    assert collected(got) == plain(rows, min_count=min_count) != []


def test_top_share_and_length(spark):
    rows = made(5)
    got = op13.collocations(table(spark, rows), longest=3, min_count=4, share=50, top=7, width=1 << 12)
    assert collected(got) == plain(rows, 3, 4, 50, 7)


@pytest.mark.parametrize("size", [5, 40, 10_000])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_lose_no_phrase(monkeypatch, size, longest):
    monkeypatch.setattr(op13, "RUN", size)
    texts = [t for t, _ in made(3, 40)] + ["one word " * 60, "", "unbroken" * 30, "a b c. d e f"]
    found = Counter()
    for name, words, carried in op13.runs(iter([pd.DataFrame({"lang": "x", "x": [t.encode() for t in texts[:9]]}), pd.DataFrame({"lang": "x", "x": [t.encode() for t in texts[9:]]})]), longest):
        run, at = op13.Run(name, words, carried), None
        for m in range(1, longest + 1):
            at = run.begins() if m == 1 else run.longer(at, m)
            found.update(tuple(w.decode() for w in words[i : i + m]) for i in run.new(at, m))
    assert found == plain_counts(texts, longest)


def test_a_sketch_never_counts_too_low(spark):
    rows = made(11)
    texts = table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("x")).repartition(3)
    bits = op13.sketch(texts, 4, 20, 1 << 10, 2)
    known = np.unpackbits(bits, axis=1, bitorder="little")
    for lang in ("en", "de", "und"):
        for phrase, n in plain_counts([t for t, name in rows if (name or "und") == lang]).items():
            if n >= 20:
                words = [w.encode() for w in phrase]
                run, at = op13.Run(lang, words, 0), None
                for m in range(1, len(words) + 1):
                    at = run.begins() if m == 1 else run.longer(at, m)
                    h = run.hashes(at, m)
                assert all(known[row][op13._cells(h[:1], row, 1 << 10)[0]] for row in range(2))


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \n\t.", None), ("so it goes " * 60_000, "en"), ("no end" * 50_000, "en"), ("same here now", "de")] + [("same here now", "de")] * 40 + [("Ünï ☃ 𝒳", "")] * 30
    df = table(spark, rows).select("*", *[F.lit(v).alias(n) for n, v in {"TEXT": "x", "phrase": 1, "n": 2, "w": "y", "a": 0}.items()])
    assert collected(op13.collocations(df, width=1 << 16)) == plain(rows)
    assert op13.collocations(df.limit(0), width=1 << 8).collect() == []
    assert op13.collocations(table(spark, rows[:1]), width=1 << 8).collect() == []


def test_query_against_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{at}/documents.parquet'")
    want = duckdb.sql(op13.sql())
    got = [tuple(r) for r in op13.query(spark, at).select(*want.columns).collect()]
    assert sorted(got) == sorted(want.fetchall()) and got
