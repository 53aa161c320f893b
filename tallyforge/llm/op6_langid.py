"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import Carried, materialize, pick, small_batches

LETTER, REST = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")
#: Bytes of each language's dictionary, and documents of each language that it is made from at most (about): the bound of the fit.
DICTIONARY_BYTES, SAMPLE_ROWS = 96 << 10, 128
#: A text is encoded in blocks, each against the dictionary alone, so that a long text's own words don't take its place.
BLOCK = 2048
#: Relative lead over the second language below which a prediction is rejected.
MARGIN = 0.005


def _remainder(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _fold(text: str) -> bytes:
    """Lower case, runs of what isn't a letter as one space."""
    return REST.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass
class Languages:
    """Dictionaries by language. ``scores(text)``: bytes that each one's encoder needs for the whole text."""

    dictionaries: dict[str, bytes]
    seen: dict[str, int]
    level: int = 9

    def __post_init__(self) -> None:
        self.names = sorted(self.dictionaries, key=lambda n: (-self.seen.get(n, 0), n))
        self.encoders = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoders": None}

    def _made(self) -> list:
        if self.encoders is None:
            self.encoders = []
            for name in self.names:
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self.encoders.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.encoders

    def scores(self, text: str) -> list[int]:
        raw = _fold(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self._made()]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted): ``und`` for null or without a letter, or if nothing was learned.

        margin: how many more bytes the second language takes, relative to the first; 1 if there is no second. score:
        tanh(50 x margin), 0 for a tie and near 1 for a wide lead. Ties go to the language with more documents to learn from, then by name.
        """
        if text is None or not self.names or not LETTER.search(text):
            return "und", 0.0, 0.0, False
        found = self.scores(text)
        order = sorted(range(len(found)), key=lambda i: (found[i], i))
        margin = found[order[1]] / found[order[0]] - 1 if len(order) > 1 else 1.0
        return self.names[order[0]], math.tanh(50 * margin), margin, margin >= MARGIN


def learn(docs: DataFrame, folds: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries from documents with a language whose crc32(key as text) mod ``folds`` isn't 0.

    A bounded sample of whole texts: of each language about 2 x ``SAMPLE_ROWS`` (all, if it has fewer) by the hash of the text, and of
    these, in order of hash, as many as fit into ``DICTIONARY_BYTES``; folded and joined. Where no sampled text fits, the shortest is
    taken whole. Copies count once. The share of the hash range to take comes from the number of different texts by language,
    so only the sample is sorted, and what leaves the executors is a dictionary's worth of texts a language. Languages are
    the distinct values of ``lang``: a label set, of which the driver keeps a row each and an executor an encoder each.
    """
    rows = pick(docs, key, text, lang).toDF("k", "x", "l").where(F.col("l").isNotNull() & F.col("x").isNotNull() & (_remainder(F.col("k"), folds) != 0))
    unit = F.pmod(F.xxhash64("x", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), (F.lit(2.0 * SAMPLE_ROWS) / F.approx_count_distinct("x")).alias("share"))
    counts = {r["l"]: (r["n"], r["share"]) for r in counts.collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for name, (_, part) in sorted(counts.items()) for x in (name, part)]), F.col("l")) if counts else F.lit(0.0)
    sample = rows.withColumn("share", share).withColumn("u", unit).where(F.col("u") < F.col("share")).select("l", "u", "x").distinct()
    size = F.octet_length("x")
    order = Window.partitionBy("l").orderBy(F.greatest(size, F.lit(DICTIONARY_BYTES)), "u", "x")
    fit = sample.withColumn("sum", F.sum(size + F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(order))
    by: dict[str, list[tuple[int, str]]] = {}
    for r in fit.where((F.col("sum") <= DICTIONARY_BYTES) | (F.col("rn") == 1)).select("l", "rn", "x").collect():
        by.setdefault(r["l"], []).append((r["rn"], r["x"]))
    return Languages({name: b" ".join(_fold(x) for _, x in sorted(texts)).ljust(8, b" ") for name, texts in by.items()}, {name: n for name, (n, _) in counts.items()})


def _predictor(model: Languages):
    @F.pandas_udf("lang_pred string, score double, margin double, accepted boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "accepted"])

    return predicted


def identify(docs: DataFrame, folds: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score, margin, accepted; see ``Languages.predict``.

    held_out: crc32(key as text) mod ``folds`` is 0 (a null key counts as the empty text). Predictions read the whole text and
    nothing else. Rows with null text or without a letter are ``und`` and not accepted, and so are all rows if no document has a
    language to learn from. An empty table gives no rows. Dictionaries (languages x 96 KiB) travel with the task.
    """
    model = learn(docs, folds, key, text, lang)
    rows = pick(docs, key, text)
    with small_batches(docs.sparkSession):
        out = materialize(rows.select(F.col(key), (_remainder(F.col(key), folds) == 0).alias("held_out"), _predictor(model)(F.col(text)).alias("p")), "languages")
    return out.select(key, "held_out", "p.lang_pred", "p.score", "p.margin", "p.accepted")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """Documents, with all columns, whose language is told by more than the margin."""
    model = learn(docs)
    carried = Carried(docs)
    with small_batches(docs.sparkSession):
        return carried.back(materialize(carried.rows.withColumn("_p", _predictor(model)(carried.col("text"))).where("_p.accepted").drop("_p"), "language-kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
