"""Mixing sources to target weights: nested hash thresholds from histograms, refined at the boundary bucket only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import Carried, contents, hashed, materialize, pick, with_copy, word_count
from tallyforge.operators.ordinals import dense

#: Bits of a document's hash, and bits that one histogram resolves: 5 levels of 4,096 buckets.
HASH_BITS, LEVEL_BITS = 60, 12
#: How near to its target a source's words must come, relative to it, before further documents are looked for that fit the rest.
NEAR = 0.0005
#: Documents that are gone through one by one at most; of more, sums by bucket tell which fit.
WALK = 10_000
_WEIGHTS = (5, 2, 1)


def _source(source: Column) -> Column:
    """A key that tells a null source from all others and sorts it last, the others by code point."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = _WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(src, source_size, target): weighted shares of ``share`` x all sizes, none above ``limit`` x its source's size.

    Excess goes to the others by weight until none is above its limit. The targets are min(level x weight, limit x size) for the
    one level that spends the whole. Each round sums what the sources stopped at this level take and what the others weigh; the
    level only rises, and rounds end when no further source stops. Sources are numbered by range partitions and summed where they
    are, so there may be as many as a corpus has domains.
    """
    per = dense(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), "src", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    per = materialize(per.select("src", "source_size", weight.cast("double").alias("w"), (F.lit(float(limit)) * F.col("source_size")).alias("stop")), "mix-sources", small=True)
    whole = float(share) * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        free = F.lit(level) * F.col("w") <= F.col("stop")
        spent, weighs, now = per.agg(F.coalesce(F.sum(F.when(~free, F.col("stop"))), F.lit(0.0)), F.sum(F.when(free, F.col("w"))), F.count_if(~free)).first()
        if now == stopped or weighs is None:
            break
        level, stopped = (whole - spent) / weighs, now
    target = F.col("stop") if weighs is None else F.least("stop", F.lit(level) * F.col("w"))
    return per.select("src", "source_size", target.alias("target"))


def _first_over(sizes: DataFrame, goals: DataFrame, bits: int) -> DataFrame:
    """(s, edge, spent): of each source the first hash at which its sizes, summed up in order of hash, pass its budget, and the sum before it; no row
    where they never do. Only documents from ``start`` on and of at most ``cap`` words count.

    Each level sums sizes by source and hash bucket (partial sums first; at most 2**bits rows a source leave a task), walks the buckets of each
    source until the budget is spent, and goes on inside the boundary bucket alone, which its upper bits tell. At the last level a bucket
    is one hash value.
    """
    state = goals.select(F.col("src").alias("s"), "budget", "start", "cap", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("spent"))
    for shift in range(HASH_BITS - bits, -1, -bits):
        left = sizes.join(state, (sizes["src"] == state["s"]) & (F.shiftright("h", shift + bits) == state["at"]) & (F.col("h") >= F.col("start")) & (F.col("size") <= F.col("cap")))
        hist = left.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        walked = hist.withColumn("cum", F.sum("n").over(w)).join(state.withColumnRenamed("s", "t"), F.col("s") == F.col("t")).where(F.col("spent") + F.col("cum") > F.col("budget"))
        over = walked.groupBy("s", "budget", "start", "cap", "spent").agg(F.min(F.struct("b", (F.col("cum") - F.col("n")).alias("before"))).alias("edge"))
        state = materialize(over.select("s", "budget", "start", "cap", F.col("edge.b").alias("at"), (F.col("spent") + F.col("edge.before")).alias("spent")), "mix-level", small=True)
    return state.select("s", F.col("at").alias("edge"), "spent")


def thresholds(sizes: DataFrame, goals: DataFrame, near: float = NEAR) -> DataFrame:
    """(src, source_size, target, times, zones, extra): every document is taken ``times``, and once more if it is in a zone or its hash is ``extra``.

    In order of hash, a document is taken once more if it still fits what is left of the budget. That is told by zones (below, cap) that follow each
    other: up to ``below``, documents of at most ``cap`` words are taken. A zone ends at the first one that doesn't fit any more; the next zone's
    cap is what is left then. Zones end when no document fits, or ``near`` x target or less is left, which for a large source is so after the first one.
    What is left at last is that little, or less than any document that isn't taken; the least of these is taken too (``extra``) if that is nearer.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    end, large = 1 << HASH_BITS, (1 << 63) - 1
    state = goals.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.withColumns({"start": F.lit(0).cast("long"), "cap": F.lit(large).cast("long")})
    state = materialize(state.withColumn("zones", F.array().cast("array<struct<below: bigint, cap: bigint>>")), "mix-zones", small=True)
    while not (open_ := state.where(f"start < {end}")).isEmpty():
        over = _first_over(sizes, open_.select("src", "budget", "start", "cap"), LEVEL_BITS)
        joined = state.join(over, state["src"] == over["s"], "left")
        below = F.coalesce("edge", F.lit(end)).cast("long")
        now = F.col("start") < end
        left = F.col("budget") - F.coalesce("spent", F.lit(0))
        go_on = now & F.col("edge").isNotNull() & (left > F.lit(near) * F.col("target")) & (left >= 1)
        state = materialize(
            joined.select(
                "src", "source_size", "target", "times",
                F.when(now, left).otherwise(F.col("budget")).alias("budget"),
                F.when(now, F.concat("zones", F.array(F.struct(below.alias("below"), F.col("cap").alias("cap"))))).otherwise(F.col("zones")).alias("zones"),
                F.when(go_on, below).otherwise(F.lit(end)).alias("start"), F.when(go_on, F.floor(left)).otherwise(F.lit(0)).cast("long").alias("cap"),
            ),
            "mix-zones", small=True,
        )
        fit = sizes.join(state.where(f"start < {end}").select(F.col("src").alias("s"), "budget", "target", "start", "cap"), F.col("src") == F.col("s")).where((F.col("h") >= F.col("start")) & (F.col("size") <= F.col("cap")) & (F.col("size") > 0))
        few = fit.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") <= WALK).select(F.col("s").alias("f"))
        more = materialize(fit.join(few, F.col("s") == F.col("f"), "left_semi").groupBy("s").applyInPandas(_walk(near, end), "s string, more array<struct<below: bigint, cap: bigint>>"), "mix-walk", small=True)
        done = state.join(more, state["src"] == more["s"], "left")
        # nothing fits a source that is open and isn't among those that have documents which fit
        some = fit.select(F.col("s").alias("o")).distinct()
        done = done.join(some, F.col("src") == F.col("o"), "left")
        ended = F.col("more").isNotNull() | F.col("o").isNull()
        state = materialize(done.select("src", "source_size", "target", "times", "budget", F.when(F.col("more").isNotNull(), F.concat("zones", "more")).otherwise(F.col("zones")).alias("zones"), F.when(ended, F.lit(end)).otherwise(F.col("start")).alias("start"), "cap"), "mix-zones", small=True)
    of = state.select(F.col("src").alias("s"), (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"), "zones")
    told = sizes.join(of, sizes["src"] == of["s"]).withColumn("took", _zoned(F.col("h"), F.col("size")))
    left = materialize(told.groupBy("s").agg((F.first("budget") - F.sum(F.when(F.col("took"), F.col("size")).otherwise(0))).alias("left")), "mix-left", small=True)
    least = told.where("not took and size > 0").drop("budget").join(left.withColumnRenamed("s", "l"), F.col("s") == F.col("l")).where(F.col("size") < 2 * F.col("left")).groupBy("s").agg(F.min(F.struct("size", "h")).alias("least"))
    return state.join(least, state["src"] == least["s"], "left").select("src", "source_size", "target", "times", "zones", F.coalesce("least.h", F.lit(-1).cast("long")).alias("extra"))


def _walk(near: float, end: int):
    """Further zones of a source of which few documents fit what is left, by going through these one by one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        left, goal, cap, zones = float(rows["budget"].iat[0]), float(rows["target"].iat[0]), int(rows["cap"].iat[0]), []
        for h, size in zip(rows["h"].tolist(), rows["size"].tolist(), strict=True):
            if size <= left:
                left -= size
            elif size <= cap:
                zones.append((h, cap))
                if not (left > near * goal and left >= 1):
                    break
                cap = int(left)
        else:
            zones.append((end, cap))
        return pd.DataFrame({"s": [rows["s"].iat[0]], "more": [[{"below": b, "cap": c} for b, c in zones]]})

    return run


def _zoned(h: Column, size: Column) -> Column:
    """Whether the zone that a hash falls into takes a document of that size."""
    zone = F.element_at(F.filter(F.concat("zones", F.array(F.struct(F.lit((1 << 63) - 1).alias("below"), F.lit(-1).cast("long").alias("cap")))), lambda z: h < z["below"]), 1)
    return size <= zone["cap"]


def _sizes(rows: DataFrame, key: Column, source: Column, text: Column, told: Column, seed: int) -> DataFrame:
    """k, size, src, alike, place, copy, h by row, as a written table. ``told`` tells rows of one key and source apart."""
    src = _source(source)
    facts = rows.select(key.alias("k"), word_count(text).alias("size"), src.alias("src"), told.alias("told"), F.xxhash64(key, key.isNull(), src, told, told.isNull()).alias("alike"), F.monotonically_increasing_id().alias("place"))
    numbered = with_copy(materialize(facts, "mix-facts"))
    return materialize(numbered.withColumn("h", hashed(seed, F.col("k"), F.col("told"), F.col("copy"))).drop("told"), "mix-sizes")


def _copies(h: Column, size: Column, limit: float) -> Column:
    """Rounds, plus one for what a zone takes; the limit counts for documents without words too."""
    return F.least(F.col("times") + F.when(_zoned(h, size) | (h == F.col("extra")), F.lit(1)).otherwise(F.lit(0)), F.lit(int(limit)))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = _WEIGHTS, share: float = 1.5, limit: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, size, source_size, target, taken, copies: how many words of each document the mix takes.

    Sources by code point, null last, have the weights in turn; see ``targets``. A document is taken 0, 1 or 2 times (taken = copies x
    size), as its source's target asks: whole rounds first, then, in order of hash, those that still fit once more; see ``thresholds``. Null
    and empty texts have size 0. Null source is a source. Hashes depend on key, text, number among rows alike in key, source and
    text, and seed, so reruns agree, and rows that share a key, or have none, are decided one by one. An empty table gives no rows.

    Texts are read once, to a written table of fixed-size rows. The final filter compares hashes and joins one row a
    source; nothing is sorted.
    """
    rows = pick(docs, key, source, text)
    sizes = _sizes(rows, F.col(key), F.col(source), F.col(text), F.md5(F.col(text).cast("binary")), seed)
    rule = thresholds(sizes, targets(sizes, weights, share, limit)).withColumnRenamed("src", "s")
    out = sizes.join(rule, sizes["src"] == rule["s"])
    times = _copies(F.col("h"), F.col("size"), limit)
    return out.select(F.col("k").alias(key), "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = _WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as the rule of ``mix`` takes it, with all its columns.

    Hashes depend on key, a hash of all columns, and number among equal rows. A row without an equal is decided where it is.
    Of equal rows as many are taken as their numbers' hashes tell: counted by the task that wrote their sizes, and given from one of them.
    """
    carried = Carried(docs)
    key, source, text = carried.col("doc_id"), carried.col("source"), carried.col("text")
    told = F.xxhash64(*contents(carried.rows))
    sizes = _sizes(carried.rows, key, source, text, told, seed)
    rule = materialize(thresholds(sizes, targets(sizes, weights, share, limit)), "mix-rule", small=True)
    several = materialize(sizes.where("copy > 0").select(F.col("alike").alias("a")).distinct(), "mix-several", small=True)

    src = _source(source)
    rows = carried.rows.select("*", F.xxhash64(key, key.isNull(), src, told, told.isNull()).alias("alike"), src.alias("_s"), hashed(seed, key, told, F.lit(0)).alias("h"), word_count(text).alias("_size"))
    equal = None
    if not several.isEmpty():
        some = sizes.join(several, sizes["alike"] == several["a"], "left_semi").join(rule, "src")
        per = some.groupBy("alike", F.shiftright("place", 33).alias("task")).agg(F.sum(_copies(F.col("h"), F.col("size"), limit)).cast("int").alias("_n")).where("_n > 0").withColumnRenamed("alike", "pa")
        one = rows.join(several, rows["alike"] == several["a"], "left_semi").groupBy("alike").agg(F.first(F.struct(*carried.rows.columns)).alias("row"))
        equal = one.join(per, one["alike"] == per["pa"]).select("row.*", "_n")
        rows = rows.join(several, rows["alike"] == several["a"], "left_anti")
    taken = rows.join(rule, F.col("_s") == F.col("src")).withColumn("_n", _copies(F.col("h"), F.col("_size"), limit).cast("int")).where("_n > 0").select(*carried.rows.columns, "_n")
    taken = taken if equal is None else taken.union(equal)
    return carried.back(taken.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_n")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    return f"""
with recursive e as (select doc_id, text, case when source is null then '1' else '0' || source end as src, row_number() over (partition by doc_id, source, text) - 1 as copy from documents),
d as (select doc_id, src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(md5(text), 'null') || ':' || copy || ':42'), 1, 15))::bigint as h from e),
per as (select src, sum(size)::bigint as source_size from d group by 1),
w as (select *, (case (row_number() over (order by src) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w, 2.0::double * source_size as stop from per),
l as (select *, coalesce(sum(stop) over (order by stop / w, src rows between unbounded preceding and 1 preceding), 0)::double as spent,
        sum(w) over (order by stop / w, src rows between current row and unbounded following)::double as left_w from w),
v as (select *, (1.5::double * (select sum(source_size) from per)::double - spent) / left_w as level from l),
f as (select level from v where level * w <= stop order by stop / w, src limit 1),
t as (select src, source_size, w, stop, least(stop, coalesce((select level from f) * w, stop)) as target from w),
g as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as times from t),
c as (select d.*, g.source_size, g.target, g.times, g.target - g.times * g.source_size as budget, row_number() over (partition by d.src order by h) as i from d join g using (src)),
b(src, i, took, r, cap, going) as (select src, 0::bigint, false, any_value(budget), 9223372036854775807::bigint, true from c group by src
  union all select c.src, c.i, b.going and c.size <= b.cap and c.size <= b.r,
    case when b.going and c.size <= b.cap and c.size <= b.r then b.r - c.size else b.r end,
    case when b.going and c.size <= b.cap and c.size > b.r then floor(b.r)::bigint else b.cap end,
    case when b.going and c.size <= b.cap and c.size > b.r then b.r > {NEAR}::double * c.target and b.r >= 1 else b.going end
  from b join c on c.src = b.src and c.i = b.i + 1),
z as (select src, max_by(r, i) as r from b group by src),
x as (select src, i from (select c.src, c.i, row_number() over (partition by c.src order by size, h) as rn from c join b using (src, i) join z using (src) where not took and size > 0 and size < 2 * z.r) where rn = 1),
k as (select c.*, least(times + case when b.took or x.i is not null then 1 else 0 end, 2) as copies from c join b using (src, i) left join x using (src, i))
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies::integer as copies from k
"""
