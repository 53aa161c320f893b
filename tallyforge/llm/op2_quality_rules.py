"""Quality rules with risk-controlled thresholds: cutoffs whose false rejections are bounded on labelled holdouts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyforge.llm.common import materialize, pick, small_batches, word_runs

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS, _SHOUTS = b"#*$%&|<>", b"!"
_UPPER = bytes(range(65, 91))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper")
#: Cutoffs: multiples k / STEP of all rules' scales together, for k = 0 ... GRID - 1. What is GRID / STEP scales or more is one bin.
STEP, GRID = 20, 200
#: Rules: a share whose high values speak against a text (a count over another), and its scale in percent: how much of it makes a text
#: suspicious by common heuristics for web text. Scales are fixed beforehand; labels choose only the multiple.
RULES: dict[str, tuple[str, str, int]] = {
    "symbols": ("n_symbols", "word_chars", 10),
    "dup_lines": ("n_dup_lines", "n_lines", 30),
    "repeats": ("n_repeat_words", "n_words", 50),
    "shouts": ("n_shouts", "word_chars", 10),
    "upper": ("n_upper", "word_chars", 30),
}

#: The share of good texts of a stratum that all rules together may reject.
RISK = 0.05


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The numbers of ``STATS`` for UTF-8 bytes of a whole text; all 0 for null.

    A text is read in runs of words. Windows of three words and lines are kept as 64-bit hashes, 8 bytes each, so a very long text takes
    a few times its size.
    """
    if not text:
        return (0,) * 8
    n = chars = symbols = shouts = upper = 0
    last, windows = [], []
    for words in word_runs(text):
        joined = b"".join(words)
        count = lambda what: len(joined) - len(joined.translate(None, what))  # noqa: B023, E731
        n, chars = n + len(words), chars + len(joined) - (0 if joined.isascii() else count(_CONTINUATION))
        symbols, shouts, upper = symbols + count(_SYMBOLS), shouts + count(_SHOUTS), upper + count(_UPPER)
        words = last + words
        windows.append(np.fromiter(map(hash, zip(words, words[1:], words[2:], strict=False)), np.int64, max(0, len(words) - 2)))
        last = words[-2:]
    lines = np.fromiter((hash(x) for x in _lines(text) if x.strip(b" \t\n\r\x0b\f")), np.int64)
    return n, chars, symbols, len(lines) - len(np.unique(lines)), _repeated(np.concatenate(windows)), len(lines), shouts, upper


def _lines(text: bytes) -> Iterator[bytes]:
    at = 0
    while (end := text.find(b"\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _repeated(windows: np.ndarray) -> int:
    """Words in windows (by their hashes, in order) that occur twice or more."""
    found, inverse, times = np.unique(windows, return_inverse=True, return_counts=True) if len(windows) else (windows,) * 3
    if len(found) == len(windows):
        return 0
    covered = np.zeros(len(windows) + 2, bool)
    for shift in range(3):
        covered[shift : len(windows) + shift] |= times[inverse] > 1
    return int(covered.sum())


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in STATS]))
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS))


def _bin(rule: str) -> Column:
    """0 to GRID: the lowest k whose cutoff doesn't reject; a share over k / STEP scales is rejected."""
    over, under, percent = RULES[rule]
    return F.least(F.lit(GRID), F.when(F.col(under) > 0, F.ceil(F.col(over) * F.lit(100 * STEP) / (F.col(under) * F.lit(percent)))).otherwise(F.lit(0))).cast("int")


class Binomial:
    """P(X <= k) for X of n trials of chance p, exactly: terms are added up from one k to the next, each found from the one before."""

    def __init__(self, n: int, p: float):
        self.n, self.odds, self.at, self.log, self.total = n, math.log(p / (1 - p)), 0, n * math.log1p(-p), math.exp(n * math.log1p(-p))

    def below(self, k: int) -> float:
        """k may only rise from call to call. Terms too small for a double are 0, which no usual level can tell from them."""
        if k >= self.n:
            return 1.0
        while self.at < k:
            i = np.arange(self.at, min(k, self.at + (1 << 16)))
            logs = self.log + np.cumsum(np.log((self.n - i) / (i + 1)) + self.odds)
            self.total += float(np.exp(logs).sum())
            self.at, self.log = int(i[-1]) + 1, float(logs[-1])
        return min(1.0, self.total)


def certify(good: list[int], bad: list[int], risk: float, delta: float) -> int | None:
    """The cutoff's k for bins of good and bad holdouts (index 0 to GRID), or None if none is certified or useful.

    Cutoffs are tried from the most lenient to the strictest; each is certified if so few good holdouts as observed would be
    rejected with chance ``delta`` at most, were the true risk above ``risk``; the first that fails ends the sequence. Testing in
    a fixed order keeps the chance of any wrong certificate at ``delta``, so one may choose freely among the certified: the
    one that rejects most bad less good holdouts, and the most lenient of those.
    """
    n, best, gain = sum(good), None, 0
    tail = Binomial(n, risk)
    rejected_good = rejected_bad = 0
    for k in range(GRID - 1, -1, -1):
        rejected_good += good[k + 1]
        rejected_bad += bad[k + 1]
        if not n or tail.below(rejected_good) > delta:
            break
        if rejected_bad - rejected_good > gain:
            best, gain = k, rejected_bad - rejected_good
    return best


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = 0.05, key: str = "doc_id") -> DataFrame:
    """(stratum, cut, n_good): certified cutoffs, from ``stats`` (k, stratum, numbers) and ``labels`` (key, quality 0 / 1).

    All rules of a stratum have one multiple of their scales for a cutoff, tested for what they reject together. So the share of good
    texts of a stratum that any rule rejects is below ``risk``, of which no rule needs a part of its own; ``delta`` is split over
    strata (Bonferroni), so that holds for all strata at once with chance 1 - delta. Holdouts with null labels don't count; a key
    labelled twice counts twice. Histograms of GRID + 1 bins by stratum and label are summed where the rows are; a stratum is
    decided from its own two.
    """
    marks = pick(labels, key, "quality").toDF("lk", "quality").where("lk is not null and quality in (0, 1)").groupBy("lk", "quality").agg(F.count("*").alias("times"))
    held = stats.join(marks, stats["k"] == marks["lk"])
    bins = held.select("stratum", "quality", "times", F.greatest(*map(_bin, RULES)).alias("b"))
    hist = materialize(bins.groupBy("stratum", "quality", "b").agg(F.sum("times").alias("n")), "quality-bins", small=True)
    level = delta / max(1, hist.where("quality = 1").select("stratum").distinct().count())

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = [0] * (GRID + 1), [0] * (GRID + 1)
        for q, b, n in zip(rows["quality"], rows["b"], rows["n"], strict=True):
            (good if q == 1 else bad)[int(b)] += int(n)
        k = certify(good, bad, risk, level)
        return pd.DataFrame({"stratum": [key[0]], "cut": [k], "n_good": [sum(good)]}).dropna()

    return materialize(hist.groupBy("stratum").applyInPandas(decide, "stratum string, cut int, n_good long"), "quality-cutoffs", small=True)


def _measured(rows: DataFrame, key: Column, text: Column, lang: Column) -> DataFrame:
    return rows.select(key.alias("k"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("stratum"), _stats(text.cast("binary")).alias("s")).select("k", "stratum", "s.*")


def _verdicts(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats with base_failed, failed_rules (comma-separated) and kept."""
    of = cuts.select(F.col("stratum").alias("cs"), "cut")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.join(of, stats["stratum"] == of["cs"], "left").withColumn("base_failed", base)
    out = out.withColumn("failed_rules", F.concat_ws(",", *[F.when(_bin(r) > F.col("cut"), F.lit(r)) for r in RULES]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = 0.05, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    Strata are languages (null: one of its own). Null and wordless texts have zeros and fail the base rule. A stratum with too
    few good holdouts to certify a cutoff has none: its texts fail by the base rule alone. No rows for an empty table. Whole
    texts are read once, to a written table of counts.
    """
    rows = pick(docs, key, text, lang)
    with small_batches(docs.sparkSession):
        stats = materialize(_measured(rows, F.col(key), F.col(text), F.col(lang)), "quality-stats")
    out = _verdicts(stats, cutoffs(stats, labels, risk, delta, key))
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sql(risk: float = RISK, delta: float = 0.05) -> str:
    """The same with windows of three words as rows, and binomial tails as sums over lgamma."""
    bins = ", ".join(f"least({GRID}, case when {under} > 0 then ceil({over} * {100 * STEP}::double / ({under} * {percent})) else 0 end)::integer as b_{rule}" for rule, (over, under, percent) in RULES.items())
    return f"""
with w as (select doc_id, coalesce('=' || lang, '') as stratum, text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w),
gw as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from g),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) as n from gw),
cov as (select doc_id, count(distinct i + o) as n_repeat_words from rep, (select unnest([0, 1, 2]) as o) o where n > 1 group by 1),
f as (select doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g'))::bigint as n_shouts,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::bigint as n_upper, list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from w),
q as (select *, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines from f),
s as (select q.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, {bins.replace("n_repeat_words", "coalesce(n_repeat_words, 0)")} from q left join cov using (doc_id)),
m as (select stratum, quality, greatest({", ".join(f"b_{r}" for r in RULES)}) as b from s join labels using (doc_id) where quality in (0, 1)),
hist as (select stratum, k, count(*) filter (quality = 1 and b > k) as rg, count(*) filter (quality = 0 and b > k) as rb, count(*) filter (quality = 1) as n
  from m, (select unnest(range(0, {GRID})) as k) k group by 1, 2),
tail as (select *, case when n = 0 then 1.0 when rg >= n then 1.0 else list_sum(list_transform(range(0, rg + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::double) + (n - i) * ln(1 - {risk}::double)))) end as p from hist),
ok as (select *, bool_and(p <= {delta}::double / (greatest(1, (select count(distinct stratum) from m where quality = 1)))) over (partition by stratum order by k desc rows unbounded preceding) as certified from tail),
cut as (select stratum, arg_max(k, (rb - rg, k)) as cut from ok where certified and rb - rg > 0 group by 1),
v as (select s.*, cut, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  array_to_string(list_filter([{", ".join(f"case when b_{r} > cut then '{r}' end" for r in RULES)}], lambda x: x is not null), ',') as failed_rules from s left join cut using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from v
"""
