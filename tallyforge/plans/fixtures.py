"""Inputs of the catalogue's queries, derived from the star-schema tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Pairs of answers on which the equivalence rules disagree.
PAIRS = [
    ("42", "42.0"), ("0.3333333", "0.3333334"), ("0.333", "0.334"), ("1,000", "1000"), ("50%", "0.5"), ("\\frac{1}{2}", "0.5"),
    ("\\dfrac{1}{2}", "\\frac{1}{2}"), ("\\frac{1}{2}x", "0.5"), ("-\\frac{1}{2}", "-0.5"), ("\\frac{1}{0}", "\\frac{1}{0}"), ("x", "y"), ("-5", "5"),
    ("a b", "ab"), (" 7 ", "7"), ('"7"', "7"), ("nan", "nan"), ("inf", "inf"), ("1d", "1"), ("\\boxed{3}", "\\boxed{3.0}"), ("(1,2)", "(1, 2)"),
    ("", ""), ("5 apples", "5"), ("\\frac{1.5}{3}", "0.5"), ("1.0000001", "1"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, k, gold, pred_m, pred_b: ten samples a problem of two models. Each ten successive rows of a part are a problem, part x 1000 + n."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    t = table(spark, sf_dir, "lineitem").select("*", (F.col("l_partkey") % 50 + 1).alias("g"), (F.row_number().over(w) - 1).alias("r")).withColumn("k", F.col("r") % 10 + 1)
    gold = F.col("g").cast("string")
    m = F.when((F.col("l_partkey") % 3 != 0) | (F.col("l_orderkey") % 2 == 0), gold).when(F.col("k") % 4 != 0, (F.col("g") + 1).cast("string"))
    b = F.when((F.col("l_partkey") % 2 == 0) | (F.col("l_linenumber") % 2 == 0), gold).otherwise((F.col("g") + 2).cast("string"))
    return t.select((F.col("l_partkey") * 1000 + F.floor(F.col("r") / 10)).alias("problem_id"), "k", gold.alias("gold"), m.alias("pred_m"), b.alias("pred_b"))


PASSES = """fx_pass as (
  select l_partkey * 1000 + r // 10 as problem_id, k, cast(g as varchar) as gold,
    case when l_partkey % 3 <> 0 or l_orderkey % 2 = 0 then cast(g as varchar) when k % 4 = 0 then null else cast(g + 1 as varchar) end as pred_m,
    case when l_partkey % 2 = 0 or l_linenumber % 2 = 0 then cast(g as varchar) else cast(g + 2 as varchar) end as pred_b
  from (select *, r % 10 + 1 as k from (select *, l_partkey % 50 + 1 as g, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 as r from lineitem) s) t)"""


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, question, answer: signed, comma-grouped, missing and plain answers after ``####``."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    x = F.when(k % 11 == 0, F.concat(F.lit("-"), size)).when(k % 7 == 0, F.concat(F.lit("1,0"), size)).when(k % 13 == 0, F.lit("none")).otherwise(size)
    return table(spark, sf_dir, "part").select(k.alias("row_id"), F.concat(F.lit("How big is part "), k.cast("string"), F.lit("?")).alias("question"), F.concat(F.lit("It has a size.\n#### "), x).alias("answer"))


PROBLEMS = """fx_prob as (
  select p_partkey as row_id, 'How big is part ' || p_partkey || '?' as question,
    'It has a size.' || chr(10) || '#### ' || case when p_partkey % 11 = 0 then '-' || p_size when p_partkey % 7 = 0 then '1,0' || p_size when p_partkey % 13 = 0 then 'none' else cast(p_size as varchar) end as answer
  from part)"""


def _style(pred: Column, style: Column) -> Column:
    n, box = F.lit("\n"), lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    p = pred.cast("string")
    return (
        F.when(style == 0, F.concat(F.lit("So {x} is "), box(p)))
        .when(style == 1, box(F.concat(F.lit("\\frac{"), (2 * pred).cast("string"), F.lit("}{2}"))))
        .when(style == 2, F.concat(F.lit("<think>\nStep 1: look.\n</think>\n<answer>\n"), box(p), F.lit("\n</answer>")))
        .when(style == 3, F.concat(F.lit("First, a\n- b\n* c\nFinally, "), box(F.lit("1")), F.lit(" "), box(F.concat(p, F.lit(".0")))))
        .when(style == 4, F.concat(F.lit("r"), n, n, F.lit("---"), n, box(p)))
        .otherwise(F.lit("I give up"))
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, problem_id, gold (long), completion: texts of six shapes."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    pred = F.col("p_size") + F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, 1).otherwise(0)
    return t.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("problem_id"), F.col("p_size").cast("long").alias("gold"), _style(pred, F.col("l_orderkey") % 6).alias("completion"))


COMPLETIONS = """fx_comp as (
  select l_orderkey, l_linenumber, problem_id, gold, case l_orderkey % 6
    when 0 then 'So {x} is ' || b || 'boxed{' || p || '}'
    when 1 then b || 'boxed{' || b || 'frac{' || 2 * p || '}{2}}'
    when 2 then '<think>' || n || 'Step 1: look.' || n || '</think>' || n || '<answer>' || n || b || 'boxed{' || p || '}' || n || '</answer>'
    when 3 then 'First, a' || n || '- b' || n || '* c' || n || 'Finally, ' || b || 'boxed{1} ' || b || 'boxed{' || p || '.0}'
    when 4 then 'r' || n || n || '---' || n || b || 'boxed{' || p || '}'
    else 'I give up' end as completion
  from (select l_orderkey, l_linenumber, l_partkey as problem_id, p_size::bigint as gold, chr(92) as b, chr(10) as n,
          p_size + case when (l_orderkey + l_linenumber) % 3 = 0 then 1 else 0 end as p
        from lineitem join part on l_partkey = p_partkey) t)"""


#: Completions that nest three deep, hold a box in a box, or never close one, and gold answers by line number; @ stands for a number.
DEEP_TEXTS = [
    "So \\boxed{\\frac{\\sqrt{@}}{2}}", "Say --- \\boxed{a \\boxed{@}", "First, ---\n- \\boxed{\\boxed{@}}", "\\boxed{1}, then --- \\boxed{{@}} and {", "\\boxed{@} --- and \\boxed{2",
    "{{\\boxed{\\text{{@}}}}} --- or \\boxed{@.0}", "<think>\nStep 1: Step 2: try.\n- look\n</think> 1 2 1 2 1 2 --- \\boxed{@}", "none of it --- none of it",
]
DEEP_GOLD = ["@", "\\boxed{@}", "\\frac{\\sqrt{@}}{2}", "", "\\text{{@}}", "@.0", "@"]


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, row_id, completion, solution: completions of eight shapes against gold answers of several."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    pred = F.col("p_size") + F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, 1).otherwise(0)
    shaped = lambda texts, at, n: F.replace(F.element_at(F.array(*map(F.lit, texts)), at.cast("int")), F.lit("@"), n.cast("string"))
    # l_orderkey and l_linenumber meet in all combinations
    return t.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        shaped(DEEP_TEXTS, (F.col("l_orderkey") + F.col("l_partkey")) % 8 + 1, pred).alias("completion"), shaped(DEEP_GOLD, F.col("l_linenumber"), F.col("p_size")).alias("solution"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: pairs with known verdicts, and last boxes against gold answers."""
    from tallyforge.functions.boxed import last_nested

    known = spark.createDataFrame(PAIRS, "a string, b string")
    return known.union(completions(spark, sf_dir).select(last_nested(F.col("completion")), F.col("gold").cast("string")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DEEP = f"""fx_deep as (
  select l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber as row_id,
    replace(list_extract([{", ".join(map(_quoted, DEEP_TEXTS))}], (l_orderkey + l_partkey) % 8 + 1), '@', cast(p_size + case when (l_orderkey + l_linenumber) % 3 = 0 then 1 else 0 end as varchar)) as completion,
    replace(list_extract([{", ".join(map(_quoted, DEEP_GOLD))}], l_linenumber), '@', cast(p_size as varchar)) as solution
  from lineitem join part on l_partkey = p_partkey)"""


def scanned(name: str, texts: str) -> str:
    """(text, boxes) of a query's distinct column ``text``: all contents of boxes with balanced braces, one character at a time."""
    return f"""{name}_walk(text, i, depth, start, boxes) as (
  select distinct text, 1::bigint, 0, 0::bigint, []::varchar[] from ({texts}) t
  union all
  select text, i + case when depth = 0 and substr(text, i, 7) = '\\boxed{{' then 7 else 1 end,
    case when depth = 0 then case when substr(text, i, 7) = '\\boxed{{' then 1 else 0 end when substr(text, i, 1) = '{{' then depth + 1 when substr(text, i, 1) = '}}' then depth - 1 else depth end,
    case when depth = 0 and substr(text, i, 7) = '\\boxed{{' then i + 7 else start end,
    case when depth = 1 and substr(text, i, 1) = '}}' then list_append(boxes, substr(text, start, i - start)) else boxes end
  from {name}_walk where i <= length(text)),
{name} as (select text, boxes from {name}_walk where i > length(text))"""


PAIRS_SQL = f"""fx_eq as (
  select * from (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in PAIRS)}) v(a, b)
  union all select list_extract(regexp_extract_all(completion, '\\\\boxed\\{{([^{{}}]+(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)\\}}', 1), -1), cast(gold as varchar) from fx_comp)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, row_id, value: an inference log in which each conversation is a segment."""
    c = table(spark, sf_dir, "conversations")
    head = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("2024-01-01 00:00:00,000 - 样本 "), F.col("conv_id").cast("string"), F.lit(" 模型输出：system")).alias("value"))
    role = c.select("conv_id", (2 * F.col("turn")).alias("ord"), F.col("role").alias("value"))
    text = c.select("conv_id", (2 * F.col("turn") + 1).alias("ord"), F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(" ")).alias("value"))
    # a file a hundred conversations
    return head.union(role).union(text).select(F.floor(F.col("conv_id") / 100).cast("string").alias("file"), (F.col("conv_id") * 1_000_000 + F.col("ord")).alias("row_id"), "value")


LOG = """fx_log as (
  select cast(floor(conv_id / 100) as bigint)::varchar as file, conv_id * 1000000 + ord as row_id, value from (
    select conv_id, -1 as ord, '2024-01-01 00:00:00,000 - 样本 ' || conv_id || ' 模型输出：system' as value from (select distinct conv_id from conversations) a
    union all select conv_id, 2 * turn, role from conversations
    union all select conv_id, 2 * turn + 1, '  ' || replace(text, chr(10), ' ') || ' ' from conversations) u)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_chars, correct."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").select("doc_id", "source", "n_chars", (F.coalesce("quality", F.lit(0)) == 1).alias("correct"))


LENGTHS = """fx_len as (
  select doc_id, source, n_chars, coalesce(quality, 0) = 1 as correct
  from documents left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, batch, ids (lengths of words), source_len."""
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch"), F.transform(words, lambda x: F.length(x)).alias("ids")).withColumn("source_len", F.floor(F.size("ids") / 3).cast("int"))


TOKENS = """fx_tok as (
  select *, len(ids) // 3 as source_len from (
    select doc_id, cast(floor(doc_id / 4) as bigint) as batch, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: length(x)) as ids from documents))"""
