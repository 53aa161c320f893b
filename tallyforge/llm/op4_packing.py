"""Length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import Carried, gapless_rank, hashed, materialize, pick, with_copy, word_count


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends (ascending, the last is the longest length) of at most ``buckets`` buckets with the least padding in all.

    Dynamic programming over the histogram by bucket; the best last split moves only up with the length, so each layer
    halves the range of candidates (divide and conquer): lengths x log(lengths) steps a layer.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate([[0.0], np.cumsum(counts, dtype=float)]), np.concatenate([[0.0], np.cumsum(counts * lengths.astype(float))])
    cost = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  lengths i..j-1 in one bucket
    best = np.array([0.0, *(cost(0, j) for j in range(1, n + 1))])
    cuts = []
    for layer in range(2, min(buckets, n) + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(layer, n, layer - 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            v = best[i] + lengths[mid - 1] * (rows[mid] - rows[i]) - (tokens[mid] - tokens[i])
            k = int(v.argmin())
            new[mid], cut[mid] = v[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return [int(lengths[j - 1]), *reversed(ends)]


def _bucket(length: Column, ends: list[int], base: int = 0) -> Column:
    if len(ends) == 1:
        return F.lit(base)
    mid = len(ends) // 2
    return F.when(length <= F.lit(ends[mid - 1]), _bucket(length, ends[:mid], base)).otherwise(_bucket(length, ends[mid:], base + mid))


def pack(docs: DataFrame, buckets: int = 8, budget: int = 65_536, seed: int = 42, key: str = "doc_id", text: str = "text", length: Column | None = None) -> DataFrame:
    """key, n_tokens, bucket, padded_len, batch_id, batch_row, batch_rows, padding.

    n_tokens: words of the whole text, or ``length`` (a column expression). Buckets 0, 1, ... have the upper ends that make the
    padding over all rows least; padded_len is the row's bucket's end. A batch of a bucket has ``budget // padded_len`` rows, one
    at least: a row longer than the budget is a batch of its own, over the budget, whole. Only the last batch of a bucket may
    have fewer rows (``batch_rows`` is the capacity). batch_id counts from 0 inside a bucket, batch_row from 0 inside a batch; rows
    go to batches by a hash of key, length and number among rows of that key and length, so a batch mixes sources, and
    repeated and null keys are spread like others. Null and empty texts have 0 tokens. Repeated rows take places of their own.
    A null ``length`` counts as 0. An empty table gives no rows.

    The driver sees the exact histogram, a row (two longs, as Arrow) for each distinct length, however long the longest is: D distinct
    word counts need at least D * (D - 1) / 2 words in all, so there are few. A ``length`` of one's own has no such bound.
    """
    if length is None:
        rows = pick(docs, *dict.fromkeys((key, text))).select(F.col(key).alias("k"), word_count(F.col(text)).alias("n_tokens"))
    else:
        rows = pick(docs.withColumn("_n_tokens", F.coalesce(length.cast("long"), F.lit(0))), key, "_n_tokens").toDF("k", "n_tokens")
    rows = materialize(rows.select("*", _alike(), F.monotonically_increasing_id().alias("place")), "pack-lengths")
    return _placed(rows, buckets, budget, seed).select(F.col("k").alias(key), *PLACES)


#: Columns that tell a row's place.
PLACES = ("n_tokens", "bucket", "padded_len", "batch_id", "batch_row", "batch_rows", "padding")


def _alike() -> Column:
    return F.xxhash64(F.col("k"), F.col("k").isNull(), F.col("n_tokens")).alias("alike")


def _placed(rows: DataFrame, buckets: int, budget: int, seed: int) -> DataFrame:
    """k, place, copy and PLACES of a written table of k, n_tokens, alike, place."""
    rows = materialize(with_copy(rows).select("k", "n_tokens", "place", "copy", hashed(seed, F.col("k"), F.col("n_tokens"), F.col("copy")).alias("h")), "pack-rows")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    ends = best_boundaries(hist["n_tokens"].to_numpy(), hist["n"].to_numpy(), buckets) or [0]
    padded = F.element_at(F.array(*[F.lit(int(e)).cast("long") for e in ends]), F.col("bucket") + 1)
    dealt = rows.withColumn("bucket", _bucket(F.col("n_tokens"), ends).cast("int")).withColumn("padded_len", padded)
    ranked = gapless_rank(dealt, "bucket", "h", 60, "r", ("k", "n_tokens", "copy"))
    fit = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div greatest(padded_len, 1L)"))
    return ranked.withColumn("batch_rows", fit).select(
        "k", "place", "copy", "n_tokens", "bucket", "padded_len", F.expr("r div batch_rows").alias("batch_id"), F.expr("r % batch_rows").alias("batch_row"), "batch_rows", (F.col("padded_len") - F.col("n_tokens")).alias("padding")
    )


def pack_documents(docs: DataFrame, buckets: int = 8, budget: int = 65_536, seed: int = 42) -> DataFrame:
    """All columns of the documents, then copy and what ``pack`` tells: rows of one (bucket, batch_id), in order of batch_row, are a batch.

    copy: 0, 1, ... of rows with one doc_id and length, so that documents which a mix repeats can be told apart. A column of the documents
    whose name (in any case) is one of those added here is returned as ``<name>_before``. Documents are written once with their
    lengths; places are found from lengths alone and joined to the documents by row.
    """
    carried = Carried(docs)
    rows = carried.rows.select("*", carried.col("doc_id").alias("k"), word_count(carried.col("text")).alias("n_tokens"))
    rows = materialize(rows.select("*", _alike(), F.monotonically_increasing_id().alias("place")), "pack-documents")
    at = _placed(rows.select("k", "n_tokens", "alike", "place"), buckets, budget, seed)
    added = ("copy", *PLACES)
    out = rows.drop("k", "n_tokens", "alike").join(at.drop("k").withColumnRenamed("place", "at"), F.col("place") == F.col("at"))
    names = [n + "_before" if n.lower() in added else n for n in carried.names]
    return out.select(*[f"_c{i}" for i in range(len(names))], *added).toDF(*names, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(buckets: int = 8, budget: int = 65_536) -> str:
    """The same by plain dynamic programming: the best cost of the first j lengths in k buckets, one table a k."""
    cost = "(hj.len * (hj.rows - coalesce(hi.rows, 0)) - (hj.tokens - coalesce(hi.tokens, 0)))"
    layers = [f"d1 as (select hj.j, {cost} as v, 0::bigint as cut from h hj left join h hi on false)"]
    layers += [f"d{k} as (select hj.j, min(p.v + {cost}) as v, arg_min(p.j, (p.v + {cost}, p.j)) as cut from h hj join d{k - 1} p on p.j < hj.j join h hi on hi.j = p.j group by hj.j)" for k in range(2, buckets + 1)]
    back = [f"e{buckets} as (select max(j) as j from h)"]
    back += [f"e{k - 1} as (select case when count(*) = 0 then (select j from e{k}) else max(cut) end as j from d{k} where j = (select j from e{k}))" for k in range(buckets, 1, -1)]
    ends = " union ".join(f"select j from e{k}" for k in range(1, buckets + 1))
    return f"""
with l as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
n as (select *, row_number() over (partition by doc_id, n_tokens) - 1 as copy from l),
t as (select *, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || n_tokens || ':' || copy || ':42'), 1, 15))::bigint as h from n),
h as (select len, row_number() over (order by len) as j, sum(n) over (order by len)::double as rows, sum(n * len) over (order by len)::double as tokens
  from (select n_tokens as len, count(*) as n from t group by 1)),
{", ".join(layers)},
{", ".join(back)},
b as (select len as padded_len, row_number() over (order by len) - 1 as bucket, coalesce(lag(len) over (order by len), -1) as under from h where j in ({ends})),
r as (select t.*, bucket::integer as bucket, padded_len::bigint as padded_len, greatest(1, {budget} // greatest(padded_len, 1))::bigint as batch_rows,
  row_number() over (partition by bucket order by h, doc_id, n_tokens, copy) - 1 as r from t join b on n_tokens > under and n_tokens <= padded_len)
select doc_id, n_tokens, bucket, padded_len, r // batch_rows as batch_id, r % batch_rows as batch_row, batch_rows, padded_len - n_tokens as padding from r
"""
