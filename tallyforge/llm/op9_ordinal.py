"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.llm.common import Carried, materialize, pick, small_batches, word_runs

#: Hash buckets of the shared weights, a power of two.
BUCKETS = 1 << 18
#: Rated documents that the fit reads at most (about): those with the smallest hashes of their key.
SAMPLE_ROWS = 16_000
#: The chance of the top grade from which a document is kept.
KEEP = 0.65
#: Buckets that get a weight: those with the highest chi-square between presence and grade. Words that few texts have would
#: else be learned by heart. The read me has figures by number; None gives all buckets a weight, held by the penalty alone.
SCREEN: int | None = 512
_LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_CAPITALS = bytes(range(65, 91))
_PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets: each word in lower case without outer punctuation, its first four and five bytes, each word's
    punctuation alone, and the text's share of distinct words and of capitals in tenths. The whole text counts; a bucket counts once,
    so length doesn't dilute a word. A text is read in runs of words; what is kept of a run are buckets and hashes of its distinct words."""
    found, first, kinds, n, size, capitals, crc, low = set(), None, [], 0, 0, 0, zlib.crc32, BUCKETS - 1
    shape, start = crc(b"\x01"), crc(b"\x04")
    for words in word_runs(text or b""):
        distinct, joined = set(words), b"".join(words)
        cores = {w.lower().strip(_PUNCTUATION) for w in distinct}
        marked = [w for w in distinct if not w.isalnum()]  # the others have letters and digits alone, so no shape
        shapes = {w.translate(None, _LETTERS) for w in marked} | ({b""} if len(marked) < len(distinct) else set())
        starts = {w[:4] for w in cores} | {w[:5] for w in cores}
        found.update({crc(w) & low for w in cores}, {crc(s, shape) & low for s in shapes}, {crc(s, start) & low for s in starts})
        if first is None:
            first = distinct
        else:  # a long text: hashes of what each run has
            kinds += [np.fromiter(map(hash, d), np.int64, len(d)) for d in ([distinct] if kinds else [first, distinct])]
        n, size, capitals = n + len(words), size + len(joined), capitals + len(joined) - len(joined.translate(None, _CAPITALS))
    if not n:
        return np.zeros(0, np.int32)
    different = len(np.unique(np.concatenate(kinds))) if kinds else len(first)
    found |= {crc(b"\x02%d" % (10 * different // n if n >= 20 else 10)) % BUCKETS, crc(b"\x03%d" % (10 * capitals // size)) % BUCKETS}
    return np.sort(np.fromiter(found, np.int32, len(found)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(sum of weights - cuts[k]) for grades 0 to len(cuts); cuts ascend."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) by row and k."""
        z = np.array([self.weights[r].sum() for r in rows], float)
        return _sigmoid(z[:, None] - self.cuts[None, :])


@dataclass
class Loss:
    """Negative log likelihood of grades under cumulative links, with a squared penalty on the weights.

    Parameters: a weight for each of ``width`` buckets, the first threshold, and the logarithms of the gaps to the next ones, so
    thresholds stay in order. ``row`` and ``at`` list the (text, bucket) pairs that are present.
    """

    row: np.ndarray
    at: np.ndarray
    grades: np.ndarray
    width: int
    top: int
    decay: float = 1.0

    def cuts(self, p: np.ndarray) -> np.ndarray:
        return p[self.width] + np.concatenate([[0.0], np.cumsum(np.exp(p[self.width + 1 :]))])

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss at p and its gradient."""
        w, g, top, c = self.width, self.grades, self.top, self.cuts(p)
        z = np.bincount(self.row, weights=p[self.at], minlength=len(g))
        lo = np.where(g > 0, _sigmoid(z - c[np.maximum(g - 1, 0)]), 1.0)  # P(grade >= g)
        hi = np.where(g < top, _sigmoid(z - c[np.minimum(g, top - 1)]), 0.0)  # P(grade > g)
        like = np.maximum(lo - hi, 1e-12)
        d_lo, d_hi = lo * (1 - lo) / like, hi * (1 - hi) / like
        dc = np.bincount(np.maximum(g - 1, 0), weights=d_lo, minlength=top) - np.bincount(np.minimum(g, top - 1), weights=d_hi, minlength=top)
        grad = np.zeros_like(p)
        grad[:w] = np.bincount(self.at, weights=(d_hi - d_lo)[self.row], minlength=w) + self.decay * p[:w]
        grad[w] = dc.sum()
        grad[w + 1 :] = np.cumsum(dc[::-1])[::-1][1:] * np.exp(p[w + 1 :])
        return float(0.5 * self.decay * (p[:w] ** 2).sum() - np.log(like).sum()), grad


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, rounds: int = 200, decay: float = 1.0) -> Ordinal:
    """Weights of the buckets in ``rows`` and thresholds that lower ``Loss``, by Adam steps on all rows.

    No rows, or one grade only: zero weights and thresholds from the (smoothed) shares of the grades.
    """
    count = np.bincount(grades, minlength=top + 1) + 0.5
    above = 1 - np.cumsum(count / count.sum())[:-1]
    cuts = -np.log(above / (1 - above))
    if not rows or len(np.unique(grades)) < 2 or not sum(map(len, rows)):
        return Ordinal(np.zeros(BUCKETS), cuts)
    used, at = np.unique(np.concatenate(rows), return_inverse=True)
    loss = Loss(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at, grades, len(used), top, decay)
    p = np.concatenate([np.zeros(len(used)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        g = loss(p)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - step / (rounds + 1)))
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = p[: len(used)]
    return Ordinal(weights, loss.cuts(p))


def screened(rows: DataFrame, top: int, most: int) -> list[int]:
    """The ``most`` buckets whose presence depends most on the grade, of rows (grade, f), by chi-square; ties go to the lower number.

    Presence is counted by bucket and grade where the rows are; the driver gets the numbers of the chosen buckets.
    """
    of = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    seen = rows.select("grade", F.explode("f").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("all"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in of])
    total, chi = sum(of.values()), F.lit(0.0)
    for g, n in of.items():
        expected = F.col("all") * F.lit(n / total)
        off = F.pow(F.col(f"g{g}") - expected, F.lit(2.0))
        chi = chi + off / F.greatest(expected, F.lit(1e-9)) + off / F.greatest(F.lit(float(n)) - expected, F.lit(1e-9))
    return [r["bucket"] for r in seen.select("bucket", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(most).select("bucket").collect()]


def ratings(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, grade) of labels quality and toxic: 0 low quality, 1 good but toxic, 2 good and not toxic; rows with a null are left out."""
    return pick(labels, key, "quality", "toxic").toDF("k", "q", "t").where("k is not null and q in (0, 1) and t in (0, 1)").select("k", F.when(F.col("q") == 0, 0).when(F.col("t") == 1, 1).otherwise(2).alias("grade"))


def learn(docs: DataFrame, rated: DataFrame, top: int = 2, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", most: int | None = SCREEN) -> Ordinal:
    """Fit on rated documents (k, grade): a bounded sample of about ``sample_rows``, those with the smallest key hashes, all if there are fewer.

    A key counts once a grade that it has, with the least of its texts, so repeated rows don't add up in a join.
    The share of the hash range comes from the count of ratings. Features are made and screened on the executors; what comes to
    the driver is at most sample_rows x ``most`` buckets, four bytes each, and its size doesn't grow with the corpus or its texts.
    With ``most`` None all buckets come, as many as there are.
    """
    share = int(min(1.0, sample_rows / max(1, rated.count())) * (1 << 30))
    within = lambda k: F.pmod(F.xxhash64(k, F.lit(9)), F.lit(1 << 30)) < F.lit(share)
    some = rated.where(within("k")).distinct()
    rows = pick(docs, key, text).toDF("dk", "x").where(F.col("dk").isNotNull() & within("dk"))
    rows = rows.join(some, rows["dk"] == some["k"], "left_semi").groupBy("dk").agg(F.min("x").alias("x"))
    with small_batches(docs.sparkSession):
        made = materialize(rows.join(some, rows["dk"] == some["k"]).select("k", "grade", _features(F.col("x").cast("binary")).alias("f")), "rated-features")
    if most is not None:
        chosen = screened(made, top, most)
        good = F.split(F.lit(",".join(map(str, chosen))), ",") if chosen else F.array()
        made = made.withColumn("f", F.array_intersect("f", good.cast("array<int>")))
    got = made.toArrow()
    got = got.sort_by([("k", "ascending"), ("grade", "ascending")])  # the same sums in each run
    return fit([np.asarray(x.values, np.int32) if x.values is not None else np.zeros(0, np.int32) for x in got.column("f").combine_chunks()] if len(got) else [], np.asarray(got.column("grade"), np.int64), top)


def _scorer(model: Ordinal):
    columns = ["expected_grade", *[f"p_above_{k}" for k in range(len(model.cuts))]]

    @F.pandas_udf(", ".join(f"{c} double" for c in columns))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tails = model.tails([features(t) for t in texts])
            yield pd.DataFrame(np.column_stack([tails.sum(axis=1), tails]), columns=columns)

    return scored


def score(docs: DataFrame, rated: DataFrame, top: int = 2, keep: float = KEEP, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", most: int | None = SCREEN) -> DataFrame:
    """One row per input row: key, expected_grade, p_above_0 ... p_above_<top - 1>, kept.

    p_above_k is the chance of a grade over k, from the whole text; expected_grade is their sum; kept: the chance of the top grade
    is ``keep`` or more. Null and wordless texts have no features: their chances are the thresholds' own. With no ratings
    all grades count as equally likely. Rows repeat as in the input; an empty table gives no rows. The weights (2 MB) travel
    with the task.
    """
    model = learn(docs, rated, top, sample_rows, key, text, most)
    with small_batches(docs.sparkSession):
        out = materialize(pick(docs, key, text).select(F.col(key), _scorer(model)(F.col(text).cast("binary")).alias("s")), "grades")
    return out.select(key, "s.*", (F.col(f"s.p_above_{top - 1}") >= F.lit(keep)).alias("kept"))


def kept_documents(docs: DataFrame, rated: DataFrame, top: int = 2, keep: float = KEEP) -> DataFrame:
    """Documents, with all columns, that ``score`` keeps."""
    model = learn(docs, rated, top)
    carried = Carried(docs)
    rows = carried.rows.withColumn("_s", _scorer(model)(carried.col("text").cast("binary")))
    with small_batches(docs.sparkSession):
        return carried.back(materialize(rows.where(F.col(f"_s.p_above_{top - 1}") >= F.lit(keep)).drop("_s"), "grade-kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
