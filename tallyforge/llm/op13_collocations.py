"""Phrase collocations: merged count-min sketches, exact counts of what survives them, scores, subsumption."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import materialize, pick, small_batches

#: Cells of a sketch's row, a power of two up to 2**32, and rows.
WIDTH, DEPTH = 1 << 26, 2
#: Cells that are merged as one.
BLOCK = 1 << 16
#: Bytes of text whose words are looked at together (below 2**22, so that two word numbers fit into 63 bits).
RUN = 4_000_000
#: Phrases that a task holds before it hands them on; splits of the scan that it reads at most, once there are two tasks a core.
HELD, SCANS = 1_000_000, 8
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Folds A to Z, makes separators line breaks and tabs spaces.
_FOLD = bytes.maketrans(_SEPARATORS + b"\t" + bytes(range(65, 91)), b"\n" * len(_SEPARATORS) + b" " + bytes(range(97, 123)))
_CUT = re.compile(rb"[ \n]")
#: Stands between pieces. No UTF-8 text has this byte.
_BREAK = b"\xff"


def _words(folded: bytes) -> list[bytes]:
    return folded.replace(b"\n", b" \xff ").split()


def runs(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words with ``_BREAK`` between pieces, words at the beginning that the run before had) of all texts (columns lang, x).

    Texts of a language are taken together up to ``RUN`` bytes. A longer text is cut at a space or line break, and each further run begins with
    the ``longest`` - 1 words before it, so no phrase is lost or met twice.
    """
    held: dict[str, list[bytes]] = {}
    size = 0
    for rows in batches:
        for name, raw in zip(rows["lang"].tolist(), rows["x"].tolist(), strict=True):
            if len(raw) <= RUN:
                held.setdefault(name, []).append(raw)
                size += len(raw)
                if size > RUN:
                    yield from _taken(held)
                    held, size = {}, 0
                continue
            folded, at, carry = raw.translate(_FOLD), 0, []
            while at < len(folded):
                cut = _CUT.search(folded, at + RUN) if at + RUN < len(folded) else None
                end = cut.end() if cut else len(folded)
                words = carry + _words(folded[at:end])
                yield name, words, len(carry)
                carry, at = words[-(longest - 1) :] if longest > 1 else [], end
    yield from _taken(held)


def _taken(held: dict[str, list[bytes]]) -> Iterator[tuple[str, list[bytes], int]]:
    for name, texts in held.items():
        # one more text may take a run over the bound: up to twice ``RUN``
        half = [texts] if sum(map(len, texts)) <= RUN else [texts[:-1], texts[-1:]]
        for some in half:
            yield name, _words(b"\n".join(some).translate(_FOLD)), 0


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Run:
    """The phrases of one run of words: where those of each length begin, and their hashes, which depend on the language."""

    def __init__(self, name: str, words: list[bytes], carried: int):
        self.distinct = list(dict.fromkeys(words))
        number = {w: i for i, w in enumerate(self.distinct)}
        self.ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.carried, seed = carried, xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct), np.uint64, len(self.distinct))[self.ids]
        self.word = self.ids != number.get(_BREAK, -1)
        self.last = self.hash  # of the phrases of the last length asked for, by beginning

    def begins(self) -> np.ndarray:
        return np.flatnonzero(self.word)

    def longer(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of phrases of ``length`` - 1 words at ``at``, those that go on by a word."""
        at = at[at + length <= len(self.ids)]
        return at[self.word[at + length - 1]]

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the phrases at ``at``; lengths are asked for in turn, and each must begin where a shorter one did."""
        if length > 1:
            now = np.zeros(len(self.ids), np.uint64)
            now[at] = _mixed(self.last[at] * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + length - 1])
            self.last = now
        return self.last[at]

    def new(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those that the run before didn't have."""
        return at if not self.carried else at[at + length > self.carried]


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """A phrase's cell in a row: rows take disjoint halves of the hash, further ones mix it again."""
    if row > 1:
        h = _mixed(h + np.uint64(row))
    return ((h >> np.uint64(32 * (row % 2))) & np.uint64(width - 1)).astype(np.int64)


def _sketched(longest: int, cap: int, width: int, depth: int):
    """A task's sketch of all phrases up to ``longest`` words, as compressed blocks (block, cells); cells stop at ``cap``.

    Sums of cells that stop there reach ``cap`` exactly where the sums of whole counts do, which is all that is asked of them.
    """
    kind = np.uint8 if cap < 1 << 8 else np.uint16 if cap < 1 << 16 else np.uint32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, pack = None, zstandard.ZstdCompressor(level=1)
        for name, words, carried in runs(batches, longest):
            if sketch is None:
                sketch = np.zeros((depth, width), kind)
            phrases, at, found = Run(name, words, carried), None, []
            for length in range(1, longest + 1):
                at = phrases.begins() if length == 1 else phrases.longer(at, length)
                h = phrases.hashes(at, length)
                found.append(h[at + length > carried] if carried else h)
            found = np.concatenate(found)
            for row in range(depth):
                cells, n = np.unique(_cells(found, row, width), return_counts=True)
                sketch[row][cells] = np.minimum(sketch[row][cells] + n, cap)
        if sketch is not None:
            step = min(BLOCK, width)
            blocks = sketch.reshape(-1, step)
            some = np.flatnonzero(blocks.any(axis=1))
            for at in range(0, len(some), 64):
                part = some[at : at + 64]
                yield pd.DataFrame({"block": part, "cells": [pack.compress(blocks[b].tobytes()) for b in part]})

    return run, kind


def _merged(cap: int, kind: type, step: int):
    """One row a block: which of its cells reach ``cap`` over all tasks, as bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, cells, unpack = -1, None, zstandard.ZstdDecompressor()

        def bits() -> pd.DataFrame:
            return pd.DataFrame({"block": [block], "bits": [np.packbits(cells >= cap, bitorder="little").tobytes()]})

        for rows in batches:
            for b, raw in zip(rows["block"].tolist(), rows["cells"].tolist(), strict=True):
                if b != block:
                    if cells is not None:
                        yield bits()
                    block, cells = b, np.zeros(step, np.int64)
                cells = np.minimum(cells + np.frombuffer(unpack.decompress(raw), kind), cap)
        if cells is not None:
            yield bits()

    return run


def sketch(rows: DataFrame, longest: int, min_count: int, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """Bits by row and cell: whether the count-min sketch of all phrases of rows (lang, x) has ``min_count`` there.

    Tasks sketch what they read, and blocks of cells are summed up over tasks where they meet. The driver gets ``width * depth / 8`` bytes (16 MB),
    however large the corpus is.
    """
    made, kind = _sketched(longest, min_count, width, depth)
    n, step = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(BLOCK, width)
    parts = rows.mapInPandas(made, "block int, cells binary")
    merged = parts.repartition(n, "block").sortWithinPartitions("block").mapInPandas(_merged(min_count, kind, step), "block int, bits binary")
    out = np.zeros((width * depth // step, max(1, step // 8)), np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(depth, -1)


def _survivors(bits: Broadcast, longest: int, width: int):
    """(lang, phrase, n): exact counts of the phrases that, with all shorter ones inside them, pass the sketch, by task; phrase null: all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = bits.value
        held: dict[str, dict[bytes | None, int]] = {}

        def out() -> pd.DataFrame:
            flat = [(name, None if p is None else p.decode(), n) for name, counts in held.items() for p, n in counts.items()]
            held.clear()
            return pd.DataFrame(flat, columns=["lang", "phrase", "n"])

        for name, words, carried in runs(batches, longest):
            phrases, counts = Run(name, words, carried), held.setdefault(name, {})
            at, passed, rank = phrases.begins(), None, None
            counts[None] = counts.get(None, 0) + len(phrases.new(at, 1))
            texts = np.array(phrases.distinct, dtype=object)
            for length in range(1, longest + 1):
                if length > 1:
                    at = phrases.longer(at, length)
                    at = at[passed[at + 1]]  # the rest of the phrase, without its first word, passed as well
                h = phrases.hashes(at, length)
                ok = np.ones(len(at), bool)
                for row in range(len(rows)):
                    cell = _cells(h, row, width)
                    ok &= (rows[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                at = at[ok]
                passed = np.zeros(len(words) + 1, bool)
                passed[at] = True
                # a phrase's number in this run: that of its beginning and its last word
                code = phrases.ids[at] if length == 1 else rank[at] * len(texts) + phrases.ids[at + length - 1]
                found, inverse = np.unique(code, return_inverse=True)
                rank = np.zeros(len(words), np.int64)
                rank[at] = inverse
                new = phrases.new(at, length)
                n = np.bincount(rank[new], minlength=len(found))
                first = np.zeros(len(found), np.int64)
                first[inverse] = at
                some = np.flatnonzero(n)
                told = [texts[phrases.ids[first[some] + i]].tolist() for i in range(length)]
                for phrase, k in zip(map(b" ".join, zip(*told, strict=True)), n[some].tolist(), strict=True):
                    counts[phrase] = counts.get(phrase, 0) + k
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()

    return run


def counts(docs: DataFrame, longest: int = 4, min_count: int = 30, text: str = "text", lang: str = "lang", width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``longest`` words that a language has ``min_count`` times or more, exactly; phrase null: its words in all.

    A first pass over the texts sketches all phrases; a second one counts those whose cells, and those of the phrases inside them, reach ``min_count``. A
    sketch never counts too low, so nothing frequent is lost, and what it counts too high falls to the exact count. Written as a table.
    """
    spark = docs.sparkSession
    rows = pick(docs, text, lang).toDF("x", "l").where("x is not null").select(F.coalesce("l", F.lit("und")).alias("lang"), F.col("x").cast("binary").alias("x"))
    # a task's sketch is as large for many texts as for few, and phrases that meet in a task are moved once
    rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // SCANS))
    with small_batches(spark):
        bits = spark.sparkContext.broadcast(sketch(rows, longest, min_count, width, depth))
        some = rows.mapInPandas(_survivors(bits, longest, width), "lang string, phrase string, n long")
        return materialize(some.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("phrase").isNull()), "phrases")


def _exact(number: Column | int) -> Column:
    return (F.lit(number) if isinstance(number, int) else number).cast("decimal(19,0)")


def collocations(docs: DataFrame, longest: int = 4, min_count: int = 30, share: int = 80, top: int = 2000, text: str = "text", lang: str = "lang", width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A to Z) are split at ``.,;:!?`` and line breaks into pieces, those at spaces and tabs into words. n: all words of
    the language; a: occurrences of the phrase, of 2 to ``longest`` words, ``min_count`` at least. Cut after some word, it has a first part (l
    occurrences) and a rest (r), and the score floor(2000000 a / (l + r)); the lowest of all cuts counts, the shortest first part among equals. A
    phrase goes if a longer one (gone itself or not) has its words in a row and at least ``share`` % of its occurrences. The others are ranked by
    score, a, both descending, and phrase in byte order. Null texts have no words; a null language is ``und``; repeated rows count each time; empty
    tables give no rows. Numbers are exact: products are decimals of up to 38 digits.

    Two passes read the texts, and what is moved are sketches (a few MB a task) and counts of phrases that passed. The sketch holds ``width`` cells
    a row in each task (128 MB in all) at any size: with many more phrases than cells x ``min_count`` it lets more pass, and the second
    pass moves more, with the same result.
    """
    known = counts(docs, longest, min_count, text, lang, width, depth)
    phrases = known.where("phrase is not null").withColumn("w", F.split("phrase", " "))
    several = phrases.where(F.size("w") > 1)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = several.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("p1"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("p2"))
    for side, out in (("p1", "l"), ("p2", "r")):
        of = phrases.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias(out))
        cuts = cuts.join(of, (cuts["lang"] == of["_l"]) & (cuts[side] == of["_p"])).drop("_l", "_p")
    score = F.call_function("div", _exact(2_000_000) * _exact(F.col("a")), _exact(F.col("l")) + _exact(F.col("r")))
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    inside = several.where(F.size("w") > 2).select("lang", "n", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inside = inside.select("lang", "n", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at")).select(F.col("lang").alias("_l"), part(F.col("at"), F.col("m")).alias("_p"), "n")
    inside = inside.groupBy("_l", "_p").agg(F.max("n").alias("longer"))
    kept = scored.join(inside, (scored["lang"] == inside["_l"]) & (scored["phrase"] == inside["_p"]), "left").where(F.col("longer").isNull() | (_exact(100) * _exact(F.col("longer")) < _exact(share) * _exact(F.col("a"))))
    total = known.where("phrase is null").select(F.col("lang").alias("_t"), F.col("n").alias("total"))
    ranked = kept.select("lang", "phrase", "a", "low").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(total, F.col("lang") == F.col("_t")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("total").alias("n"), F.col("low.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    return r"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from p, unnest(range(1, 5)) a(m), unnest(range(1, len(w) - m + 2)) b(i)),
f as (select lang, m, phrase, count(*)::hugeint as n from g group by all having count(*) >= 30),
c as (select lang, phrase, m, n as a, string_split(phrase, ' ') as w from f where m > 1),
cut as (select c.*, k, array_to_string(w[1:k], ' ') as p1, array_to_string(w[k + 1:], ' ') as p2 from c, unnest(range(1, m)) k(k)),
s as (select cut.lang, cut.phrase, a, k, x.n as l, y.n as r, (2000000 * a) // (x.n + y.n) as score from cut join f x on x.lang = cut.lang and x.phrase = p1 join f y on y.lang = cut.lang and y.phrase = p2),
low as (select *, row_number() over (partition by lang, phrase order by score, k) as rn from s),
i as (select lang, array_to_string(w[j:j + q - 1], ' ') as phrase, max(a) as longer from c, unnest(range(2, m)) q(q), unnest(range(1, m - q + 2)) j(j) group by all),
o as (select low.*, row_number() over (partition by low.lang order by score desc, a desc, phrase) as rank from low left join i using (lang, phrase) where rn = 1 and (longer is null or 100 * longer < 80 * a)),
n as (select lang, sum(len(w))::bigint as n from p group by 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n.n, score::bigint as score from o join n using (lang) where rank <= 2000
"""
