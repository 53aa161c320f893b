"""Toxicity by two Kneser-Ney models, of toxic and of ordinary texts, that share their lower orders."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import materialize, pick, small_batches

#: Characters of an n-gram: the one foretold and those before it. What is held back of each count.
ORDER, DISCOUNT = 5, 0.75
#: Labelled documents (about) that the two numbers of the calibration are fit on: those with the least hashes of their keys.
CALIBRATION_ROWS = 16_000
#: N-grams that are broadcast at once; a larger model is used in as many passes as it takes.
SHARD_ROWS = 2_000_000
#: Folds of the key's crc32. Fold 0 is held out.
FOLDS = 5
#: Bits that tell most documents without a label before their texts are moved.
FILTER_BITS = 1 << 22
#: Words and n-grams that a task remembers.
HELD = 400_000
_WORD = re.compile(r"\w+")
_START, _END = "\x02", "\x03"
#: Odd numbers, for hashes of windows of characters.
_ODD = np.random.default_rng(12).integers(1 << 62, (1 << 63) - 1, 16, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def words_of(text: str | None, size: int = 1 << 20) -> Iterator[list[str]]:
    """The words of a whole text in lower case, in runs, so that a very long text isn't one list; nothing for null."""
    text, at = text or "", 0
    while at < len(text):
        end = at + size
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def grams_of(word: str) -> list[str]:
    """A word's n-grams: each character and the end of the word, with the characters before it back to its beginning."""
    padded = _START * (ORDER - 1) + word + _END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct n-grams of texts (column x), by task."""
    seen, grams = set(), set()
    for rows in batches:
        for text in rows["x"].tolist():
            for words in words_of(text):
                for word in set(words) - seen:
                    grams.update(grams_of(word))
                seen.update(words)
        if len(seen) > HELD or len(grams) > HELD:
            yield pd.DataFrame({"gram": np.array(list(grams), dtype=object)}, dtype=object)
            seen, grams = set(), set()
    yield pd.DataFrame({"gram": np.array(list(grams), dtype=object)}, dtype=object)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, toxic, fold, n) of labelled texts (x, toxic, fold), by task."""
    held: dict[tuple[int, int], Counter] = {}

    def out() -> pd.DataFrame:
        flat = []
        for (toxic, fold), words in held.items():
            n: Counter = Counter()
            for word, k in words.items():
                for gram in grams_of(word):
                    n[gram] += k
            flat += [(g, toxic, fold, k) for g, k in n.items()]
        held.clear()
        grams, toxic, folds, n = zip(*flat, strict=True) if flat else ((), (), (), ())
        return pd.DataFrame({"gram": np.array(grams, dtype=object), "toxic": np.array(toxic, np.int32), "fold": np.array(folds, np.int32), "n": np.array(n, np.int64)}).astype({"gram": object})

    for rows in batches:
        for text, toxic, fold in zip(rows["x"].tolist(), rows["toxic"].tolist(), rows["fold"].tolist(), strict=True):
            at = held.setdefault((toxic, fold), Counter())
            for words in words_of(text):
                at.update(words)
        if sum(map(len, held.values())) > HELD:
            yield out()
    yield out()


def _remainder(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, x, toxic, fold) of documents (k, x) with a label, fold 0 left out.

    Texts are moved to meet their labels. A bitmap of hashed keys (512 KB, at any number of labels) first drops most of those that have none.
    """
    place = lambda k: F.pmod(F.xxhash64(k, F.lit(12)), F.lit(FILTER_BITS)) + 1
    some = labels.select("k", place(F.col("k")).alias("p"))
    bits = some.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bits", (F.call_function("div", at, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = docs.where("k is not null and x is not null").withColumn("fold", _remainder(F.col("k"))).where("fold <> 0").withColumn("p", place(F.col("k")))
    # at most FILTER_BITS / 8 bytes: a bound that holds at any size
    rows = rows.join(F.broadcast(bits), F.bitmap_bucket_number("p") == F.col("b")).where(F.bit_get(byte, (at % 8).cast("int")) == 1).select("k", "x", "fold")
    return rows.join(labels.withColumnRenamed("k", "lk"), F.col("k") == F.col("lk")).select("k", "x", "toxic", "fold")


def shared(types: DataFrame) -> DataFrame:
    """(rest, p): the chance of the last character of ``rest`` (``ORDER`` - 1 characters) after those before it, from distinct n-grams of all texts.

    Counts are of continuations: how many different characters come before. Each order holds ``DISCOUNT`` of each count back for the order
    below; the lowest gives all characters that end an n-gram the same.
    """
    kinds, above = {}, types
    for m in range(ORDER - 1, 0, -1):
        above = kinds[m] = materialize(above.groupBy(F.substring("gram", 2, m).alias("gram")).agg(F.count("*").alias("c")), "toxic-continuations")
    known = None
    for m in range(1, ORDER):
        context = Window.partitionBy(F.substring("gram", 1, m - 1))  # of the lowest order: all different characters
        rows = kinds[m].select("gram", "c", F.sum("c").over(context).alias("s"), F.count("*").over(context).alias("t"))
        below = 1.0 / F.col("t")
        if known is not None:
            rows, below = rows.join(known, F.substring("gram", 2, m - 1) == F.col("rest")), F.col("p")
        known = rows.select(F.col("gram").alias("rest"), ((F.col("c") - DISCOUNT) / F.col("s") + DISCOUNT * F.col("t") / F.col("s") * below).alias("p"))
    return known


def model(types: DataFrame, counted: DataFrame) -> DataFrame:
    """(gram, v0 ... v4): what an n-gram, or a context of ``ORDER`` - 1 characters, adds to the ratio of a text; v<k> without fold k.

    P(x | h) of a class is (n(h x) - D) / n(h) + D t(h) / n(h) p(x | h'), with the class's own counts n, its number t of different x after h, and the
    shared p of one character less; p alone after an h that the class doesn't have. The ratio is the sum of log P(x | h, toxic) - log P(x | h,
    ordinary), less what ordinary texts are expected to give after h. So a context for which one class has few texts, as in a rare
    language, doesn't move it by itself. Where neither class has h x, p cancels. An n-gram has here what it adds beside an unseen one
    of its context; a context, the expectation of that over ordinary texts, subtracted; neither has a row if unseen.
    """
    folds = [f"{c}{k}" for c in "to" for k in range(FOLDS)]
    n = lambda c, k: F.sum(F.when((F.col("toxic") == int(c == "t")) & (F.col("fold") != k), F.col("n")).otherwise(0))
    sums = counted.groupBy("gram").agg(*[n(f[0], int(f[1])).alias(f) for f in folds])
    after = Window.partitionBy(F.substring("gram", 1, ORDER - 1))
    sums = sums.select("*", *[F.sum(f).over(after).alias(f"s{f}") for f in folds], *[F.count_if(F.col(f) > 0).over(after).alias(f"d{f}") for f in folds])
    kept = {f: F.when(F.col(f"s{f}") > 0, DISCOUNT * F.col(f"d{f}") / F.col(f"s{f}")).otherwise(1.0) for f in folds}
    chance = {f: F.when(F.col(f) > 0, (F.col(f) - DISCOUNT) / F.col(f"s{f}")).otherwise(0.0) + kept[f] * F.col("p") for f in folds}
    told = sums.join(shared(types), F.substring("gram", 2, ORDER - 1) == F.col("rest"))
    told = told.select("gram", *[chance[f"o{k}"].alias(f"p{k}") for k in range(FOLDS)], *[(F.log(chance[f"t{k}"] / chance[f"o{k}"]) - F.log(kept[f"t{k}"] / kept[f"o{k}"])).alias(f"v{k}") for k in range(FOLDS)])
    told = materialize(told, "toxic-grams")
    contexts = told.groupBy(F.substring("gram", 1, ORDER - 1).alias("gram")).agg(*[(-F.sum(F.col(f"p{k}") * F.col(f"v{k}"))).alias(f"v{k}") for k in range(FOLDS)])
    return materialize(told.select("gram", *[f"v{k}" for k in range(FOLDS)]).union(contexts), "toxic-model")


def _hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` symbols."""
    n = len(symbols) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h += symbols[i : i + n] * _ODD[i]
    h = (h ^ (h >> np.uint64(31))) * _ODD[14]
    return h ^ (h >> np.uint64(29))


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class Grams:
    """N-grams and contexts by hash, ascending, and what each adds."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(grams: list[str], values: np.ndarray) -> Grams:
        keys = np.zeros(len(grams), np.uint64)
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        for width in (ORDER - 1, ORDER):
            at = np.flatnonzero(size == width)
            if len(at):
                keys[at] = _hashes(_symbols("".join(grams[i] for i in at)), width)[::width]
        order = np.argsort(keys)
        if len(keys) > 1 and (np.diff(keys[order]) == 0).any():
            raise ValueError("two n-grams have one hash")
        return Grams(keys[order], values[order].astype(np.float64))

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], 0.0)

    def _windows(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) - ORDER + 1
        return self._found(_hashes(symbols, ORDER)) + self._found(_hashes(symbols[:-1], ORDER - 1)[:n])

    def words(self, words: list[str], step: int = 1 << 18) -> list[float]:
        """What each word adds, over its characters and its end."""
        out: list[float] = []
        part: list[str] = []
        size = 0
        for word in words:
            if len(word) > step:  # alone, window by window
                out += self._some(part)
                part, size = [], 0
                symbols = _symbols(_START * (ORDER - 1) + word + _END)
                out.append(float(sum(self._windows(symbols[i : i + step + ORDER - 1]).sum() for i in range(0, len(word) + 1, step))))
                continue
            part.append(word)
            size += len(word)
            if size > step:
                out += self._some(part)
                part, size = [], 0
        return out + self._some(part)

    def _some(self, words: list[str]) -> list[float]:
        if not words:
            return []
        symbols = _symbols("".join([_START * (ORDER - 1) + w + _END for w in words]))
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + ORDER)
        inside = np.ones(len(symbols), bool)
        for back in range(ORDER - 1):  # windows that begin so near to a word's end hold some of the next word
            inside[ends - 1 - back] = False
        windows = self._windows(symbols)[inside[: len(symbols) - ORDER + 1]]
        return np.add.reduceat(windows, np.concatenate([[0], np.cumsum(length + 1)[:-1]])).tolist()


def _summed(models, by_fold: bool):
    """Per text: what its words add, by the model without the text's fold or by the first of the broadcast models, and its characters and word ends."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        grams: list[Grams] = models.value
        known: list[dict[str, float]] = [{} for _ in grams]
        for texts, folds in batches:
            sums, sizes = [], []
            for text, fold in zip(texts.tolist(), folds.tolist(), strict=True):
                at = fold if by_fold else 0
                cache, parts, size = known[at], [], 0
                for words in words_of(text):
                    if new := [w for w in set(words) if w not in cache]:
                        if len(cache) + len(new) > HELD:
                            cache.clear()
                            new = list(set(words))
                        cache.update(zip(new, grams[at].words(new), strict=True))
                    parts.append(math.fsum(map(cache.__getitem__, words)))
                    size += sum(map(len, words)) + len(words)
                sums.append(math.fsum(parts))
                sizes.append(size)
            yield pd.DataFrame({"s": sums, "size": sizes})

    return F.pandas_udf(run, "s double, size long")


def _shards(grams: DataFrame, rows: int) -> int:
    return max(1, -(-grams.count() // rows))


def _shard(grams: DataFrame, at: int, shards: int, columns: list[str]):
    """A shard of the model, of about ``SHARD_ROWS`` n-grams, for all executors."""
    got = grams.where(F.pmod(F.xxhash64("gram", F.lit(7)), F.lit(shards)) == at).select("gram", *columns).toArrow()
    names = got.column("gram").to_pylist()
    return grams.sparkSession.sparkContext.broadcast([Grams.of(names, np.asarray(got.column(c), np.float32)) for c in columns])


def added(rows: DataFrame, grams: DataFrame, by_fold: bool = False, shard_rows: int | None = None) -> DataFrame:
    """Rows (x, fold, ...) with s, what the words of x add in all, and size, their characters and ends; x goes.

    A model of more than ``shard_rows`` n-grams is used shard by shard, each over all texts: sums add up. Texts meet their sums again by 128 bits
    of hash.
    """
    columns = [f"v{k}" for k in range(FOLDS)] if by_fold else ["v0"]
    shards = _shards(grams, shard_rows or SHARD_ROWS)
    rest = [c for c in rows.columns if c != "x"]
    scored = lambda at, keep: rows.select(*keep, _summed(_shard(grams, at, shards, columns), by_fold)("x", "fold").alias("_v"))
    with small_batches(rows.sparkSession):
        if shards == 1:
            return materialize(scored(0, rest), "toxic-sums").select(*rest, "_v.s", "_v.size")
        marks = [F.xxhash64(F.col("x"), F.col("x").isNull(), F.col("fold"), F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)]
        all_ = None
        for at in range(shards):
            one = scored(at, marks).groupBy("h1", "h2").agg(F.first("_v").alias("_v"))
            one = materialize(one, "toxic-sums")
            all_ = one if all_ is None else all_.union(one)
        whole = all_.groupBy(F.col("h1").alias("_1"), F.col("h2").alias("_2")).agg(F.sum("_v.s").alias("s"), F.first("_v.size").alias("size"))
        of = rows.select(*rest, *marks)
        return of.join(whole, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))).select(*rest, "s", "size")


def calibrated(x: np.ndarray, y: np.ndarray, decay: float = 0.01) -> tuple[float, float]:
    """(a, b) of P(toxic) = sigmoid(a + b x), by Newton steps on the penalised likelihood; the slope is penalised in units of x's deviation."""
    scale = float(x.std()) or 1.0
    z = np.column_stack([np.ones(len(x)), (x - x.mean()) / scale])
    w, hold = np.zeros(2), np.diag([1e-6, decay])
    loss = lambda w: np.logaddexp(0, z @ w).sum() - (z @ w)[y == 1].sum() + 0.5 * w @ hold @ w
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (p - y) + hold @ w)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * x.mean() / scale), float(w[1] / scale)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", calibration_rows: int = CALIBRATION_ROWS, shard_rows: int | None = None) -> DataFrame:
    """One row per input row: key, held_out, score, predicted, log_ratio, size.

    log_ratio: log P(text | toxic) - log P(text | ordinary), less what ordinary text would give (see ``model``), over the ``size`` characters and word
    ends of the whole text; score: the chance of a toxic label given log_ratio / size; predicted: 1 if score >= 0.5. Class counts come from all labelled rows outside of fold 0 (a key's crc32
    mod 5), the shared lower orders from the texts of all documents. The calibration is fit on about ``calibration_rows`` labelled rows, each scored by
    a model without its fold. Repeated documents count each time, a key with both labels in both classes.

    Null, empty and wordless texts get the share of toxic labels. So do all texts if only one class has labels; without any labels scores are 0.
    A null key has fold 0 or not as the empty text has. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, key, text).toDF("k", "x")
    rated = pick(labels, key, "toxic").toDF("k", "toxic").where("k is not null and toxic in (0, 1)").select("k", F.col("toxic").cast("int").alias("toxic")).distinct()
    rated = materialize(rated.where(_remainder(F.col("k")) != 0), "toxic-labels", small=True)
    of = {r["toxic"]: r["n"] for r in rated.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(of.values())
    prior = (of.get(1, 0) + 0.5) / (total + 1) if total else 0.0
    fold = _remainder(F.col("k"))
    plain = lambda score: (score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    found = None
    if len(of) == 2:
        with small_batches(spark):
            types = materialize(rows.where("x is not null").select("x").mapInPandas(_types, "gram string").distinct(), "toxic-types")
            counted = materialize(_labelled(rows, rated).select("x", "toxic", "fold").mapInPandas(_counted, "gram string, toxic int, fold int, n long").groupBy("gram", "toxic", "fold").agg(F.sum("n").alias("n")), "toxic-counts")
        if not counted.isEmpty():
            grams = model(types, counted)
            share = min(1.0, calibration_rows / total)
            some = rated.where(F.pmod(F.xxhash64("k", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)))
            held = added(_labelled(rows, some), grams, True, shard_rows).where("size > 0").select((F.col("s") / F.col("size")).alias("x"), "toxic").toArrow()
            x, y = np.asarray(held.column("x"), float), np.asarray(held.column("toxic"), int)
            if len(np.unique(y)) == 2:
                order = np.lexsort((y, x))  # the same sums in each run
                a, b = calibrated(x[order], y[order])
                found = added(rows.select("k", "x", fold.alias("fold")), grams, False, shard_rows)
    if found is None:
        return rows.select(F.col("k").alias(key), (fold == 0).alias("held_out"), *plain(F.lit(prior)), F.lit(0.0).alias("log_ratio"), F.lit(0).cast("long").alias("size"))
    chance = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(a) + F.lit(b) * F.col("s") / F.col("size")))))
    return found.select(F.col("k").alias(key), (F.col("fold") == 0).alias("held_out"), *plain(F.when(F.col("size") > 0, chance).otherwise(F.lit(prior))), F.col("s").alias("log_ratio"), "size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
