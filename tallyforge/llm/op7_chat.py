"""Multi-party chat: for every participant, the dialogue with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import materialize, pick

#: The chat markup and the heads of turns.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MINE, OTHER, SYSTEM = "assistant", "user name=", "system"
#: Characters (of speakers, texts and markup) of a dialogue that one row holds; a longer dialogue goes on in further rows.
PART_CHARS = 1 << 20
_FRAME = len(OPEN) + len(OTHER) + len(CLOSE) + 2


def _plain(text: Column) -> Column:
    """The markup's own strings become ordinary text, so that nothing inside a turn can forge another."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |im_start| >")), F.lit(CLOSE), F.lit("< |im_end| >"))


def _name(speaker: Column) -> Column:
    """A speaker as it stands in a turn's head: plain, on one line."""
    return F.translate(_plain(speaker), "\r\n", "  ")


def _numbered(rows: DataFrame, long: DataFrame, part_chars: int) -> DataFrame:
    """Rows of long dialogues with their part ``p``: the characters before a row, in order of (turn, speaker, text), over ``part_chars``.

    Rows are dealt to range partitions of that order once, ties by place, and written; sums by dialogue and partition give what is
    before each, so a dialogue that holds most of a table is numbered by many tasks, also if all its turns are alike.
    """
    order = ("t", "s", "x", "place")
    some = rows.join(long, rows["c"] == long["long"], "left_semi").withColumn("place", F.monotonically_increasing_id())
    some = materialize(some.repartitionByRange("c", *order).withColumn("cell", F.spark_partition_id()), "chat-long")
    sums = some.groupBy(F.col("c").alias("sc"), F.col("cell").alias("scell")).agg(F.sum("cost").alias("n"))
    ahead = sums.select("sc", "scell", (F.sum("n").over(Window.partitionBy("sc").orderBy("scell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    here = F.sum("cost").over(Window.partitionBy("c", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")
    placed = some.withColumn("here", here).join(ahead, (F.col("c") == F.col("sc")) & (F.col("cell") == F.col("scell")))
    return placed.select("c", "t", "s", "x", "cost", F.floor((F.col("ahead") + F.col("here")) / F.lit(part_chars)).cast("long").alias("p"))


def _starts(long_rows: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """(zc, zp, zme, start) of long dialogues: code points of the rotation before a part. Own turns have another head than others'."""
    head = F.when(F.col("s").isin(*system), F.lit(len(SYSTEM))).otherwise(F.length(_name(F.col("s"))) + F.lit(len(OTHER)))
    told = (F.lit(len(OPEN) + len(CLOSE) + 2) + head + F.length("x")).cast("long")
    per = materialize(long_rows.groupBy("c", "p", "s").agg(F.sum(told).alias("told"), F.count("*").alias("n")), "chat-parts")
    before = lambda *group: Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("c", "p").agg(F.sum("told").alias("told")).select("c", "p", F.coalesce(F.sum("told").over(before("c")), F.lit(0)).alias("ahead"))
    people = per.where(~F.col("s").isin(*system)).select(F.col("c").alias("mc"), F.col("s").alias("me")).distinct()
    own = per.select(F.col("c").alias("oc"), F.col("p").alias("op"), F.col("s").alias("os"), "n")
    both = parts.join(people, F.col("c") == F.col("mc")).join(own, (F.col("c") == F.col("oc")) & (F.col("p") == F.col("op")) & (F.col("me") == F.col("os")), "left")
    mine = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before("c", "me")), F.lit(0))
    start = F.col("ahead") - mine * (F.length(_name(F.col("me"))) + F.lit(len(OTHER) - len(MINE)))
    return both.select(F.col("c").alias("zc"), F.col("p").alias("zp"), F.col("me").alias("zme"), start.alias("start"))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",), part_chars: int = PART_CHARS) -> DataFrame:
    """One row per dialogue and participant: conversation, perspective, part, start, n_turns, n_target_turns, text, spans, mask.

    Every speaker but the system ones is a participant; its rotation has its own turns as ``assistant``, all others' as
    ``user name=<speaker>`` and system turns as ``system``. Turns stand in order of (turn, speaker, text). ``mask`` has a 1 for each
    target turn and a 0 for each other one; ``spans`` lists ``start:end`` (code points from the dialogue's beginning, end excluded) of each
    target turn's content with its end mark, comma-separated, empty if there is none.

    A dialogue is one row, part 0 with start 0. One of more than ``part_chars`` characters goes on in rows of part 1, 2, ...: the texts of
    a rotation's parts, joined, are the whole dialogue, their masks its mask, and spans count on; ``start`` is the place of
    a part's first character. So a dialogue that holds a large share of all turns is rendered by many tasks, whatever its turn
    numbers. Such a part has a row for every participant, also for one who is silent in it.

    Null text: an empty turn. Null speaker: a participant named ``unknown``. Null turn: before all others. Null conversation: each
    row is a dialogue of its own. Repeated turns are kept. Markup inside texts and speakers becomes plain text, and line ends in a
    speaker's name blanks. A dialogue of system turns only, and an empty table, give no rows.
    """
    cost = (F.length("x") + F.length("s") + F.lit(_FRAME)).cast("long")
    rows = pick(turns, conversation, turn, speaker, text).toDF("c", "t", "s", "x")
    rows = rows.select("c", F.col("t").cast("long").alias("t"), F.coalesce(F.col("s"), F.lit("unknown")).alias("s"), _plain(F.col("x")).alias("x")).withColumn("cost", cost)
    known = rows.where("c is not null")
    long = materialize(known.groupBy("c").agg(F.sum("cost").alias("n")).where(F.col("n") > part_chars).select(F.col("c").alias("long")), "chat-lengths", small=True)
    placed, starts = known.withColumn("p", F.lit(0).cast("long")), None
    if not long.isEmpty():
        long_rows = materialize(_numbered(known, long, part_chars), "chat-numbered")
        placed = placed.join(long, placed["c"] == long["long"], "left_anti").select("c", "t", "s", "x", "cost", "p").union(long_rows)
        starts = _starts(long_rows, system)
    told = placed.groupBy("c", "p").agg(F.sort_array(F.collect_list(F.struct("t", "s", "x"))).alias("turns"))
    people = known.where(~F.col("s").isin(*system)).select(F.col("c").alias("pc"), F.col("s").alias("me")).distinct()
    both = told.join(people, told["c"] == people["pc"]).select("c", "p", "turns", "me")
    if starts is None:
        both = both.withColumn("start", F.lit(0).cast("long"))
    else:
        both = both.join(starts, (F.col("c") == F.col("zc")) & (F.col("p") == F.col("zp")) & (F.col("me") == F.col("zme")), "left").select("c", "p", "turns", "me", F.coalesce("start", F.lit(0)).alias("start"))
    single = rows.where(F.col("c").isNull() & ~F.col("s").isin(*system)).select("c", F.lit(0).cast("long").alias("p"), F.array(F.struct("t", "s", "x")).alias("turns"), F.col("s").alias("me"), F.lit(0).cast("long").alias("start"))
    return _rendered(both.union(single), conversation, system)


def _rendered(both: DataFrame, conversation: str, system: tuple[str, ...]) -> DataFrame:
    head = lambda m: F.concat(F.lit(OPEN), F.when(m["s"].isin(*system), F.lit(SYSTEM)).when(m["s"] == F.col("me"), F.lit(MINE)).otherwise(F.concat(F.lit(OTHER), _name(m["s"]))), F.lit("\n"))
    both = both.withColumn("pieces", F.transform("turns", lambda m: F.struct(F.concat(head(m), m["x"], F.lit(CLOSE + "\n")).alias("piece"), F.length(head(m)).alias("skip"), (m["s"] == F.col("me")).alias("mine"))))
    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))
    step = lambda a, m: F.struct((a["at"] + F.length(m["piece"])).alias("at"), F.when(m["mine"], F.concat(a["spans"], F.array(F.concat_ws(":", (a["at"] + m["skip"]).cast("string"), (a["at"] + F.length(m["piece"]) - 1).cast("string"))))).otherwise(a["spans"]).alias("spans"))
    return both.select(
        F.col("c").alias(conversation), F.col("me").alias("perspective"), F.col("p").alias("part"), "start",
        F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda m: m["mine"])).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("pieces", lambda m: m["piece"]), "").alias("text"),
        F.array_join(F.aggregate("pieces", begin, step, lambda a: a["spans"]), ",").alias("spans"),
        F.array_join(F.transform("pieces", lambda m: F.when(m["mine"], F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def sql() -> str:
    """The same for dialogues of one part."""
    plain = lambda x: f"replace(replace({x}, '{OPEN}', '< |im_start| >'), '{CLOSE}', '< |im_end| >')"
    return f"""
with r as (select conv_id as c, coalesce(cast(conv_id as varchar), 'row ' || row_number() over ()) as g, turn as t, coalesce(role, 'unknown') as s, {plain("coalesce(text, '')")} as x from conversations),
people as (select distinct g, s as me from r where s <> 'system'),
m as (select r.*, me, s = me as mine,
        '{OPEN}' || case when s = 'system' then '{SYSTEM}' when s = me then '{MINE}' else '{OTHER}' || replace(replace({plain("s")}, chr(13), ' '), chr(10), ' ') end || chr(10) as head
      from r join people using (g)),
q as (select *, head || x || '{CLOSE}' || chr(10) as piece, row_number() over (partition by g, me order by t nulls first, s, x) as k from m),
z as (select *, coalesce(sum(length(piece)) over (partition by g, me order by k rows between unbounded preceding and 1 preceding), 0) as pos from q)
select any_value(c) as conv_id, me as perspective, 0::bigint as part, 0::bigint as start, count(*) as n_turns, count(*) filter (mine) as n_target_turns,
  string_agg(piece, '' order by k) as text,
  coalesce(string_agg(cast(cast(pos + length(head) as bigint) as varchar) || ':' || cast(cast(pos + length(piece) - 1 as bigint) as varchar), ',' order by k) filter (mine), '') as spans,
  string_agg(case when mine then '1' else '0' end, '' order by k) as mask
from z group by g, me
"""
