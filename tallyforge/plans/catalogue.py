"""Queries by name, and SQL of each for the oracle engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.functions import arrays, boxed, equivalence, external, numbers, records, rewards, text
from tallyforge.operators import collate, conversations, evaluation, jobs, joins, logs, passrate, prompts, remote, requests, scoring, sets, splits
from tallyforge.operators.ordinals import dense, shuffled
from tallyforge.plans import fixtures as fx, rules
from tallyforge.plans.fixtures import table
from tallyforge.sources import readers, scratch, writers
from tallyforge.streaming import chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ("l_orderkey", "l_linenumber")
SYSTEM = "You are a careful solver."


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


# Pass rates and difficulty

_RATE = "sum(case when {p} is not distinct from gold then 1 else 0 end) / 10.0::double"


@query(_with(fx.PASSES) + f"select problem_id, gold, {_RATE.format(p='pred_m')} as pass_rate from fx_pass group by 1, 2")
def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return passrate.pass_rate(fx.passes(spark, d), ["problem_id", "gold"], F.col("pred_m"), F.col("gold"))


_BOXED_NUMBER = r"case when regexp_matches(completion, '\\boxed\{(-?\d+(?:\.\d+)?)\}') then round(regexp_extract(completion, '\\boxed\{(-?\d+(?:\.\d+)?)\}', 1)::double, 5) end"


@query(_with(fx.COMPLETIONS) + f"select problem_id, sum(case when ({_BOXED_NUMBER}) is not distinct from gold::double then 1 else 0 end) / 10.0::double as pass_rate, count(*) as n from fx_comp group by 1")
def pass_rate_boxed(spark: SparkSession, d: str) -> DataFrame:
    c = fx.completions(spark, d)
    hit = equivalence.sampled_hit(numbers.rounded_number(boxed.first_numeric(F.col("completion"))), F.col("gold").cast("double")).cast("int")
    return c.groupBy("problem_id").agg((F.sum(hit) / F.lit(10.0)).alias("pass_rate"), F.count("*").alias("n"))


@query(_with(fx.PASSES) + "select problem_id, string_agg(coalesce(pred_m, 'null'), ',' order by k) as predictions, " + _RATE.format(p="pred_m") + " as pass_rate from fx_pass group by 1")
def predictions_in_order(spark: SparkSession, d: str) -> DataFrame:
    p = passrate.predictions(fx.passes(spark, d), ["problem_id", "gold"], "k", F.col("pred_m"))
    return p.select("problem_id", F.array_join("predictions", ",", "null").alias("predictions"), passrate.rate_of(F.col("predictions"), F.col("gold")).alias("pass_rate"))


_M = "m as (select problem_id from fx_pass group by 1 having sum(case when pred_m is not distinct from gold then 1 else 0 end) = 10)"
_B = "b as (select problem_id from fx_pass group by 1 having sum(case when pred_b is not distinct from gold then 1 else 0 end) = 10)"


def _solved(spark: SparkSession, d: str, column: str) -> DataFrame:
    return passrate.all_right(passrate.pass_rate(fx.passes(spark, d), ["problem_id"], F.col(column), F.col("gold")))


@query(_with(fx.PASSES, _M) + ", r as (select *, row_number() over (order by problem_id) - 1 as gsm8k_index from (select distinct problem_id from fx_pass)) select gsm8k_index, problem_id, 1.0::double as pass_rate from r join m using (problem_id)")
def pass_all_filter(spark: SparkSession, d: str) -> DataFrame:
    rates = passrate.pass_rate(fx.passes(spark, d), ["problem_id"], F.col("pred_m"), F.col("gold"))
    return passrate.all_right(dense(rates, "problem_id", "gsm8k_index")).select("gsm8k_index", "problem_id", "pass_rate")


@query(_with(fx.PASSES, _M, _B) + "select problem_id from m intersect select problem_id from b")
def very_easy_intersect(spark: SparkSession, d: str) -> DataFrame:
    return sets.intersection(_solved(spark, d, "pred_m"), _solved(spark, d, "pred_b"), "problem_id")


@query(_with(fx.PASSES, _M, _B) + "select problem_id from m except select problem_id from b")
def easy_difference(spark: SparkSession, d: str) -> DataFrame:
    return sets.difference(_solved(spark, d, "pred_m"), _solved(spark, d, "pred_b"), "problem_id")


@query(_with(fx.PASSES, _M, _B) + "select distinct problem_id, gold from fx_pass where problem_id not in (select problem_id from m union select problem_id from b)")
def hard_complement(spark: SparkSession, d: str) -> DataFrame:
    universe = fx.passes(spark, d).select("problem_id", "gold").distinct()
    return sets.complement(universe, _solved(spark, d, "pred_m"), _solved(spark, d, "pred_b"), "problem_id")


@query(_with(fx.PASSES, _M, _B) + "select problem_id from m union select problem_id from b")
def key_union(spark: SparkSession, d: str) -> DataFrame:
    return sets.union(_solved(spark, d, "pred_m"), _solved(spark, d, "pred_b"), "problem_id")


@query(_with(fx.PASSES, _M, fx.PROBLEMS) + "select row_id, question from fx_prob where row_id in (select problem_id // 1000 from m)")
def semi_join_index(spark: SparkSession, d: str) -> DataFrame:
    return sets.members(fx.problems(spark, d), _solved(spark, d, "pred_m").select(F.floor(F.col("problem_id") / 1000).alias("row_id")), "row_id").select("row_id", "question")


@query(_with(fx.PASSES, _M, fx.PROBLEMS) + "select row_id, question from fx_prob where row_id not in (select problem_id // 1000 from m)")
def anti_join_index(spark: SparkSession, d: str) -> DataFrame:
    return sets.strangers(fx.problems(spark, d), _solved(spark, d, "pred_m").select(F.floor(F.col("problem_id") / 1000).alias("row_id")), "row_id").select("row_id", "question")


@query(_with(fx.PASSES, _M, _B) + "select (select count(*) from m) as solved_m, (select count(*) from b) as solved_b, (select count(*) from m join b using (problem_id)) as both, (select count(distinct problem_id) from fx_pass) as problems")
def difficulty_counts(spark: SparkSession, d: str) -> DataFrame:
    p = fx.passes(spark, d)
    hit = lambda c: F.sum(equivalence.sampled_hit(numbers.rounded_number(F.col(c)), numbers.rounded_number(F.col("gold"))).cast("int")) == 10
    per = p.groupBy("problem_id").agg(hit("pred_m").alias("m"), hit("pred_b").alias("b"))
    return per.agg(F.count_if("m").alias("solved_m"), F.count_if("b").alias("solved_b"), F.count_if(F.col("m") & F.col("b")).alias("both"), F.count("*").alias("problems"))


# Extraction


def _extract(name: str, build: Callable, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fx.completions(spark, d).select(*KEY, build(F.col("completion")).alias("found"))

    run.__name__ = name
    query(_with(fx.COMPLETIONS) + f"select l_orderkey, l_linenumber, {sql} as found from fx_comp")(run)


_extract("boxed_first_numeric", boxed.first_numeric, r"nullif(regexp_extract(completion, '\\boxed\{(-?\d+(?:\.\d+)?)\}', 1), '')")
_extract("boxed_last_simple", boxed.last_simple, r"list_extract(regexp_extract_all(completion, '\\boxed\{([^}]+)\}', 1), -1)")
_extract("boxed_first_depth2", boxed.first_nested, f"nullif(trim(regexp_extract(completion, {rules.NESTED}, 1)), '')")
_extract("boxed_all_depth2", lambda c: F.array_join(boxed.all_nested(c), ";"), f"array_to_string(regexp_extract_all(completion, {rules.NESTED}, 1), ';')")
_extract("boxed_leftover_mark", lambda c: boxed.without_leftover_mark(F.concat(F.lit("\\boxed{"), boxed.last_simple(c))), r"rtrim(list_extract(regexp_extract_all(completion, '\\boxed\{([^}]+)\}', 1), -1), '}')")
_extract("extract_numbers_all", lambda c: F.array_join(text.numbers_in(c), ";"), f"array_to_string({rules.numbers('completion')}, ';')")
_extract("format_reward", rewards.tagged, r"case when regexp_matches(completion, '(?sm)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$') then 1.0::double else 0.0::double end")
_TAGS = ("'<think>' || chr(10)", "chr(10) || '</think>' || chr(10)", "chr(10) || '<answer>' || chr(10)", "chr(10) || '</answer>'")
_extract("tag_count", rewards.tag_count, " + ".join(f"(case when (length(completion) - length(replace(completion, {t}, ''))) / length({t}) = 1 then 0.25::double else 0.0::double end)" for t in _TAGS))
_extract("reasoning_steps", rewards.reasoning_steps, r"least(1.0::double, len(regexp_extract_all(completion, '(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0::double)")


_BOXES = fx.scanned("fx_box", "select completion as text from fx_deep")
#: What follows the last mark, as a text that begins with it.
_LAST_MARK = r"case when contains(completion, '\boxed{') then '\boxed{' || list_extract(string_split(completion, '\boxed{'), -1) end"
_LAST = fx.scanned("fx_last", f"select text from (select {_LAST_MARK} as text from fx_deep) where text is not null")


@query(_with(fx.DEEP, _BOXES) + "select l_orderkey, l_linenumber, array_to_string(boxes, ';') as found from fx_deep join fx_box on completion = text")
def boxed_balanced_all(spark: SparkSession, d: str) -> DataFrame:
    return fx.deep(spark, d).select(*KEY, F.array_join(boxed.all_balanced(F.col("completion")), ";").alias("found"))


@query(_with(fx.DEEP, _LAST) + f"select l_orderkey, l_linenumber, list_extract(boxes, 1) as found from fx_deep left join fx_last on {_LAST_MARK} = text")
def boxed_balanced_last(spark: SparkSession, d: str) -> DataFrame:
    return fx.deep(spark, d).select(*KEY, boxed.last_balanced(F.col("completion")).alias("found"))


@query(r"select doc_id, array_to_string(regexp_extract_all(text, '([-+]?\d*\.\d+|\d+)', 1), ';') as found from documents")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.numbers_in(F.col("text")), ";").alias("found"))


@query(_with(fx.PROBLEMS) + r"select row_id, nullif(regexp_extract(answer, '####\s*(\d+(?:\.\d+)?)', 1), '') as gold from fx_prob")
def gt_hash_marker(spark: SparkSession, d: str) -> DataFrame:
    return fx.problems(spark, d).select("row_id", text.marked_answer(F.col("answer")).alias("gold"))


@query(_with(fx.PROBLEMS) + ", t as (select row_id, regexp_replace(list_extract(string_split(answer, '####'), -1), '[^0-9.\\-]+', '', 'g') as digits from fx_prob) select row_id, digits, round(try_cast(nullif(digits, '') as double), 5) as gold from t")
def gt_digits(spark: SparkSession, d: str) -> DataFrame:
    return fx.problems(spark, d).select("row_id", text.digits_after_mark(F.col("answer")).alias("digits")).withColumn("gold", numbers.rounded_number(F.col("digits")))


# Equivalence


def _equal(name: str, build: Callable, sql: Callable[[str], str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fx.pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", build(F.col("a"), F.col("b")).alias("equal"), "n")

    run.__name__ = name
    query(_with(fx.COMPLETIONS, fx.PAIRS_SQL) + f"select a, b, same as equal, count(*) as n from {sql('fx_eq')} group by all")(run)


_equal("values_equal_v1", equivalence.plain, rules.plain)
_equal("values_equal_v2", equivalence.with_fractions, rules.with_fractions)
_equal("values_equal_v3", equivalence.lenient, rules.lenient)
_equal("values_equal_v5", equivalence.loose, rules.loose)
_equal("verify_answer_last", equivalence.by_numbers, rules.by_numbers)


@query(
    _with(fx.COMPLETIONS, f"one as (select *, row_number() over () as rid from fx_comp), boxes as (select rid, problem_id, trim(unnest(regexp_extract_all(completion, {rules.NESTED}, 1))) as a0, cast(gold as varchar) as b0 from one)")
    + f", v as (select a, b, bool_or(same) as same from {rules.by_numbers('(select distinct a0 as a, b0 as b from boxes)')} z group by 1, 2), r as (select rid, problem_id, bool_or(same) as accepted from boxes join v on a0 = a and b0 = b group by 1, 2) select problem_id, accepted, count(*) as n from r group by 1, 2"
)
def verify_answer_any(spark: SparkSession, d: str) -> DataFrame:
    c = fx.completions(spark, d).where(F.size(boxed.all_nested(F.col("completion"))) > 0)
    gold = F.col("gold").cast("string")
    any_ = F.exists(boxed.all_nested(F.col("completion")), lambda x: equivalence.by_numbers(boxed.without_leftover_mark(text.strip(x)), gold))
    return c.select("problem_id", any_.alias("accepted")).groupBy("problem_id", "accepted").agg(F.count("*").alias("n"))


# Requests, responses, usage


@query(
    _with(fx.PROBLEMS)
    + f"select 'request-' || (row_id + 1) as custom_id, 'POST' as method, '/v1/chat/completions' as url, 'solver' as model, '{SYSTEM}' as system_content, question as user_content, 2::bigint as n_messages from fx_prob"
)
def request_build(spark: SparkSession, d: str) -> DataFrame:
    r = requests.build(fx.problems(spark, d), F.col("question"), "solver", SYSTEM)
    m = F.col("body.messages")
    return r.select("custom_id", "method", "url", "body.model", F.get(m, F.lit(0))["content"].alias("system_content"), requests.first_user(m).alias("user_content"), F.size(m).cast("long").alias("n_messages"))


_RESPONSES = """resp as (select l_orderkey, l_linenumber, case when l_linenumber = 7 then '' else 'request-' || (l_partkey + case when l_orderkey % 10 = 0 then 1000000 else 0 end) end as custom_id from lineitem),
req as (select 'request-' || row_id as custom_id, question, row_id from fx_prob union all select 'request-' || row_id, 'How big is part ' || (row_id - 1) || '?', row_id + 10000000 from fx_prob where row_id % 5 = 0),
req1 as (select custom_id, arg_max(question, row_id) as question from req group by 1),
gt as (select question, nullif(regexp_extract(answer, '####\\s*(\\d+(?:\\.\\d+)?)', 1), '') as gold, row_id from fx_prob),
gt1 as (select question, arg_max(gold, row_id) as gold from gt where gold is not null group by 1)"""


@query(_with(fx.PROBLEMS, _RESPONSES) + "select l_orderkey, l_linenumber, question, gold from resp join req1 using (custom_id) join gt1 using (question) where custom_id <> ''")
def response_join_lastwins(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("l_partkey") + F.when(F.col("l_orderkey") % 10 == 0, 1_000_000).otherwise(0)
    responses = table(spark, d, "lineitem").select(*KEY, F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("request-"), known.cast("string"))).alias("custom_id"))
    p = fx.problems(spark, d)
    asked = p.select(F.concat(F.lit("request-"), F.col("row_id").cast("string")).alias("custom_id"), "question", "row_id")
    again = p.where("row_id % 5 = 0").select(F.concat(F.lit("request-"), F.col("row_id").cast("string")), F.concat(F.lit("How big is part "), (F.col("row_id") - 1).cast("string"), F.lit("?")), F.col("row_id") + 10_000_000)
    gold = p.select("question", text.marked_answer(F.col("answer")).alias("gold"), "row_id").where("gold is not null")
    return joins.answered(responses, asked.union(again), gold).select(*KEY, "question", "gold")


@query(
    _with(fx.PROBLEMS)
    + r""", a as (select row_id, row_number() over (order by row_id) - 1 as position from fx_prob where regexp_matches(answer, '####\s*(\d+(?:\.\d+)?)')),
b as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as position from orders)
select position, row_id, o_orderkey from a join b using (position)"""
)
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    a = fx.problems(spark, d).where(text.marked_answer(F.col("answer")).isNotNull()).select("row_id")
    b = table(spark, d, "orders").select("o_orderkey")
    return joins.by_position(a, b, "row_id", "o_orderkey")


@query("select doc_id, n_chars from documents where coalesce(n_chars, 0) between 1 and 4096")
def usage_filter(spark: SparkSession, d: str) -> DataFrame:
    return requests.within_usage(table(spark, d, "documents"), F.col("n_chars")).select("doc_id", "n_chars")


@query("select count(*) as total, count(*) filter (coalesce(n_chars, 0) between 1 and 4096) as kept, count(*) filter (not coalesce(n_chars, 0) between 1 and 4096) as discarded from documents")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return requests.usage_counts(table(spark, d, "documents"), F.col("n_chars"))


@query(
    _with(fx.PROBLEMS)
    + "select 'request-' || row_id as custom_id, length(question)::bigint as prompt_tokens, length(answer)::bigint as completion_tokens, (length(question) + length(answer))::bigint as total_tokens, case when row_id % 2 = 0 then 'finetuned-' else '' end || 'solver-7b' as model, answer as content from fx_prob"
)
def prediction_record(spark: SparkSession, d: str) -> DataFrame:
    used = requests.usage(F.length("question").cast("long"), F.length("answer").cast("long"))
    r = fx.problems(spark, d).select(*requests.prediction(F.col("row_id"), F.col("question"), used, F.lit("/models/solver-7b"), F.col("row_id") % 2 == 0, F.lit(None).cast("string"), F.col("answer")))
    return r.select("custom_id", "usage.*", "model", "message.content")


# Conversations and prompts


@query("select conv_id, arg_min(text, (turn, text)) as content from conversations where role = 'user' group by 1")
def first_user_message(spark: SparkSession, d: str) -> DataFrame:
    return conversations.first_user(table(spark, d, "conversations"))


_PAIRS = """s as (select conv_id, count(*) as n, string_agg(role, ',' order by turn, role, text) as roles, bool_or(not regexp_matches(text, '\\S')) as blank, sum(length(text)) // 4 as est from conversations group by 1)"""
_PAIR = "n = 2 and roles = 'user,assistant'"


@query(_with(_PAIRS) + f"select conv_id, est::bigint as estimate from s where {_PAIR}")
def role_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    c = conversations.gathered(table(spark, d, "conversations")).where(conversations.is_pair(m))
    return c.select("conv_id", numbers.token_estimate(F.get(m, F.lit(0))["content"], F.get(m, F.lit(1))["content"]).alias("estimate"))


@query(_with(_PAIRS) + f"select case when not ({_PAIR}) or blank then 'malformed' when est > 128 then 'long' else 'kept' end as reason, count(*) as n from s group by 1")
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return conversations.reason_counts(conversations.gathered(table(spark, d, "conversations")), conversations.skip_reason(F.col("messages"), longest=128))


@query("select conv_id, turn, role, length(text) // 4 as estimate from conversations")
def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", numbers.token_estimate(F.col("text")).alias("estimate"))


@query(f"select conv_id, turn, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt from conversations where role = 'user'")
def chatml_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", prompts.chatml(SYSTEM, F.col("text")).alias("prompt"))


@query("select conv_id, turn, case when turn % 2 = 0 then 'system:s|' else '' end || 'user:' || text as messages from conversations")
def messages_flat(spark: SparkSession, d: str) -> DataFrame:
    m = prompts.messages(F.col("text"), F.when(F.col("turn") % 2 == 0, "s").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


@query("select conv_id, turn, coalesce(case when role = 'assistant' then 'because' end, '') || chr(10) || chr(10) || '---' || chr(10) || text as combined from conversations")
def reasoning_combine(spark: SparkSession, d: str) -> DataFrame:
    why = F.when(F.col("role") == "assistant", "because")
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.with_reasoning(why, F.col("text")).alias("combined"))


@query(_with(fx.PROBLEMS) + f"select '{SYSTEM}' as instruction, question as input, chr(10) || chr(10) || '---' || chr(10) || answer || '<eos>' as output from fx_prob where length(question) > 0 and length(answer) > 0")
def supervised_record(spark: SparkSession, d: str) -> DataFrame:
    return prompts.supervised(fx.problems(spark, d), F.col("question"), F.lit(None).cast("string"), F.col("answer"), SYSTEM, "<eos>")


@query(_with(fx.COMPLETIONS) + f"select problem, solution, count(*) as n from (select 'p' || problem_id as problem, nullif(trim(regexp_extract(completion, {rules.NESTED}, 1)), '') as solution from fx_comp) where solution is not null group by 1, 2")
def problem_solution(spark: SparkSession, d: str) -> DataFrame:
    c = fx.completions(spark, d).select(F.concat(F.lit("p"), F.col("problem_id").cast("string")).alias("question"), F.col("completion").alias("content"))
    return prompts.problem_solution(c).groupBy("problem", "solution").agg(F.count("*").alias("n"))


# Rewards

_LENGTH = "round(case when hi = lo then 0.0::double when correct then 0.5::double - (n_chars - lo) / (hi - lo)::double else least(0.0::double, 0.5::double - (n_chars - lo) / (hi - lo)::double) end, 9)"


@query(_with(fx.LENGTHS) + f"select doc_id, {_LENGTH} as reward from (select *, min(n_chars) over (partition by source) as lo, max(n_chars) over (partition by source) as hi from fx_len)")
def length_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.with_bounds(fx.lengths(spark, d), F.col("n_chars"), ["source"])
    return rows.select("doc_id", F.round(rewards.length(F.col("n_chars"), F.col("correct"), F.col("low"), F.col("high")), 9).alias("reward"))


@query(_with(fx.LENGTHS) + "select doc_id, round(case when correct then 0.5::double + 0.25::double * (1 + cos(n_chars / 1000.0::double * pi())) else -0.5::double + 0.25::double * (1 + cos(n_chars / 1000.0::double * pi())) end, 9) as reward from fx_len")
def cosine_reward(spark: SparkSession, d: str) -> DataFrame:
    return fx.lengths(spark, d).select("doc_id", F.round(rewards.Cosine()(F.col("n_chars"), F.col("correct")), 9).alias("reward"))


@query("select doc_id, round(case when n_chars <= 12288 then 0.0::double when n_chars <= 16384 then (12288 - n_chars) / 4096.0::double else -1.0::double end, 9) as reward from documents")
def overlong(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(rewards.overlong(F.col("n_chars")), 9).alias("reward"))


_GRAMS = """w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents),
g as (select doc_id, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end as g from w)"""


@query(_with(_GRAMS) + "select doc_id, round(case when len(g) > 0 then -(1 - len(list_distinct(g)) / len(g)::double) else 0.0::double end, 9) + 0.0::double as reward from g")
def repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.round(rewards.repetition_batches()(F.col("text")), 9) + F.lit(0.0)).alias("reward"))


@query(SQL["repetition_penalty"])
def repetition_penalty_native(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.round(rewards.repetition(F.col("text")), 9) + F.lit(0.0)).alias("reward"))


# one answer counts for all completions of an order: its first line's
_BATCH = """fx_batch as (select *, first_value(case when l_orderkey % 13 = 0 then 'no box' else chr(92) || 'boxed{' || solution || '}' end) over (partition by l_orderkey order by l_linenumber, solution) as answer from fx_deep)"""
_ANSWER_MARK = _LAST_MARK.replace("completion", "answer")
_FIRST_GOLD = fx.scanned("fx_gold", f"select text from (select {_ANSWER_MARK} as text from fx_batch) where text is not null")


@query(
    _with(fx.DEEP, _LAST, _BATCH, _FIRST_GOLD)
    + f""", j as (select l_orderkey, l_linenumber, completion, list_extract(fx_last.boxes, 1) as a, list_extract(fx_gold.boxes, 1) as b from fx_batch left join fx_last on {_LAST_MARK} = fx_last.text left join fx_gold on {_ANSWER_MARK} = fx_gold.text),
v as (select a, b, same from {rules.loose("(select distinct a, b from j)")} z)
select l_orderkey, l_linenumber, case when j.b is null or j.a is null or (length(completion) - length(replace(completion, '---', ''))) / 3 <> 1 then 0.0::double when same then 2.0::double else 0.2::double end as reward
from j left join v on j.a = v.a and j.b = v.b"""
)
def grpo_reward(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("l_orderkey") % 13 == 0, "no box").otherwise(F.concat(F.lit("\\boxed{"), F.col("solution"), F.lit("}")))
    rows = scoring.with_batch_answer(fx.deep(spark, d), answer, ["l_orderkey"], F.struct("l_linenumber", "solution"))
    return scoring.with_composite(rows, F.col("completion"), F.col("batch_answer")).select(*KEY, "reward")


#: Each completion's last box by the balanced scan (a), and whether it equals the gold answer.
_LENIENT = _with(fx.DEEP, _BOXES, "fx_a as (select fx_deep.*, list_extract(boxes, -1) as a from fx_deep join fx_box on completion = text)", f"v as (select a, b, same from {rules.lenient('(select distinct a, solution as b from fx_a)')} z)")
_JUDGED = "fx_a left join v on fx_a.a = v.a and solution = v.b"
_STEPS = r"least(1.0::double, len(regexp_extract_all(completion, '(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0::double)"
_REPEATS = """rep as (select text, case when len(g) > 0 then -(1 - len(list_distinct(g)) / len(g)::double) else 0.0::double end as repeats from (
  select text, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end as g from (
    select text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from fx_box)))"""


@query(_LENIENT + f", {_REPEATS} select l_orderkey, l_linenumber, round(coalesce(case when same then 1.0::double when not same then 0.0::double end, 0.0::double) + 0.2::double * {_STEPS} + 0.4::double * repeats, 9) + 0.0::double as reward from {_JUDGED} join rep on completion = text")
def weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    names = list(rewards.WEIGHTS)
    rows = scoring.with_scores(fx.deep(spark, d), names)
    return rows.select(*KEY, (F.round(rewards.weighted({n: F.col(n) for n in names}), 9) + F.lit(0.0)).alias("reward"))


# Evaluation


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by row, written once: a filter on a verdict would else be moved below all the steps that lead to it."""
    return scratch.written(evaluation.judged(fx.deep(spark, d), "completion", "solution").select("row_id", "verdict", "method"), "verdicts")


_VERDICT = f"j as (select *, case when solution = '' or fx_a.a is null then 'skipped' when same then 'right' else 'wrong' end as verdict from {_JUDGED})"


@query(_LENIENT + f", {_VERDICT} select count(*) filter (verdict <> 'skipped') as total, count(*) filter (verdict = 'right') as correct, round(100.0::double * count(*) filter (verdict = 'right') / count(*) filter (verdict <> 'skipped'), 9) as accuracy, count(*) filter (verdict = 'skipped') as skipped, 0::bigint as symbolic, count(*) filter (verdict <> 'skipped') as text from j")
def accuracy_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_judged(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query(_LENIENT + f", {_VERDICT} select row_id from j where verdict = 'wrong'")
def error_indices(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.indices(_judged(spark, d), "wrong", "row_id")


@query(_LENIENT + f", {_VERDICT} select string_agg(cast(row_id as varchar), ',' order by row_id) as first from (select row_id from j where verdict = 'skipped' order by row_id limit 20)")
def skipped_indices_preview(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.index_preview(_judged(spark, d), "skipped", "row_id").select(F.array_join("first", ",").alias("first"))


# Shuffles, splits, mixtures

_SHUFFLED = "(select *, row_number() over (order by md5('{seed}:' || doc_id), doc_id) - 1 as at, count(*) over () as n from {of}) t"


@query("select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as position from documents")
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 42, "position")


@query("select doc_id, case when pos < floor(n * 0.8) then 'train' when pos < floor(n * 0.9) then 'val' else 'test' end as split from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents)")
def split_80_10_10(spark: SparkSession, d: str) -> DataFrame:
    return splits.three_way(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("select doc_id, case when pos < n - floor(n * 5 / 100) then 'train' else 'eval' end as split from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents)")
def split_pct(spark: SparkSession, d: str) -> DataFrame:
    return splits.held_out(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (order by md5('0:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents) where pos < floor(n * 0.25)")
def weighted_subsample(spark: SparkSession, d: str) -> DataFrame:
    return splits.subsample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.25)


_PARTS = """p0 as (select '0:' || doc_id as _key, text from (select doc_id, text, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents) where pos < floor(n * 0.5)),
p1 as (select '1:' || item_id as _key, text from benchmark),
m as (select _key, text, row_number() over (order by md5('7:' || _key), _key) - 1 as position, count(*) over () as n from (select * from p0 union all select * from p1))"""


@query(_with(_PARTS) + "select _key, md5(text) as text_md5, position, case when position < n - floor(n * 0.1) then 'train' else 'test' end as split from m")
def mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = splits.Part(table(spark, d, "documents"), "doc_id", ("text",), 0.5)
    items = splits.Part(table(spark, d, "benchmark"), "item_id", ("text",), None)
    return splits.mixture([docs, items], seed=7, test_size=0.1).select("_key", F.md5("text").alias("text_md5"), "position", "split")


@query("select conv_id, role, md5(text) as h, 'conversations' as origin from conversations union all select item_id, 'user', md5(text), 'benchmark' from benchmark")
def bag_concat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "conversations").select("conv_id", "role", F.md5("text").alias("h"), F.lit("conversations").alias("origin"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit("user").alias("role"), F.md5("text").alias("h"), F.lit("benchmark").alias("origin"))
    return sets.concat([a, b])


# Token arrays

_JOINED = "array_to_string({}, ',')"
_MASK = "list_transform(list_zip(ids, range(len(ids))), lambda z: case when z[2] < source_len then -100 else z[1] end)"


@query(_with(fx.TOKENS) + f"select doc_id, {_JOINED.format(_MASK)} as labels from fx_tok")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    return fx.tokens(spark, d).select("doc_id", F.array_join(arrays.label_mask(F.col("ids"), F.col("source_len")).cast("array<string>"), ",").alias("labels"))


@query(
    _with(fx.TOKENS)
    + """, c as (select doc_id, batch, list_slice(ids, 1, 4096) as ids, source_len from fx_tok),
w as (select *, max(len(ids)) over (partition by batch) as wide from c)
select doc_id, batch, md5(array_to_string(list_concat(ids, list_transform(range(wide - len(ids)), lambda i: 0)), ',')) as input_md5,
  md5(array_to_string(list_concat(""" + _MASK + """, list_transform(range(wide - len(ids)), lambda i: -100)), ',')) as label_md5,
  len(ids)::bigint as attended, wide::bigint as width from w"""
)
def pad_collate(spark: SparkSession, d: str) -> DataFrame:
    c = collate.collated(fx.tokens(spark, d), "batch", "ids", "source_len")
    joined = lambda n: F.md5(F.array_join(F.col(n).cast("array<string>"), ","))
    return c.select("doc_id", "batch", joined("input_ids").alias("input_md5"), joined("labels").alias("label_md5"), arrays.mask_length(F.col("attention_mask")).cast("long").alias("attended"), F.size("input_ids").cast("long").alias("width"))


@query(_with(fx.TOKENS) + "select doc_id, len(list_filter(ids, lambda x: x <> 2))::bigint as n_tokens, array_to_string(list_transform(ids, lambda x: case when x <> 2 then 1 else 0 end), '') as mask from fx_tok")
def attention_mask(spark: SparkSession, d: str) -> DataFrame:
    t = fx.tokens(spark, d)
    bits = F.transform(arrays.attention(F.col("ids"), 2), lambda x: x.cast("int").cast("string"))
    return t.select("doc_id", arrays.token_count(F.col("ids"), 2).cast("long").alias("n_tokens"), F.array_join(bits, "").alias("mask"))


# Logs


_SEGMENTS = """h as (select *, regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2},\\d{3} - 样本 (\\d+) 模型输出：') as head from fx_log),
n as (select *, count(*) filter (head) over (partition by file order by row_id rows unbounded preceding) as segment from h),
s as (select file, segment, max(case when head then regexp_extract(value, '样本 (\\d+) 模型', 1)::bigint end) as gsm8k_index,
  coalesce(string_agg(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), chr(10) order by row_id) filter (not head), '') as body from n where segment > 0 group by 1, 2),
p as (select *, strpos(body, 'assistant') as mark from s)"""


@query(
    _with(fx.LOG, _SEGMENTS)
    + "select file, segment, gsm8k_index, md5(body) as body_md5, case when mark > 0 then regexp_replace(left(body, mark - 1), '^\\s+|\\s+$', '', 'g') end as question, case when mark > 0 then regexp_replace(substr(body, mark + 9), '^\\s+|\\s+$', '', 'g') end as answer from p"
)
def log_segments(spark: SparkSession, d: str) -> DataFrame:
    return logs.segments(fx.log(spark, d)).select("file", "segment", "gsm8k_index", F.md5("body").alias("body_md5"), "question", "answer")


# Names and paths


@query(r"select s_suppkey, regexp_replace(s_name || ' & co/7b', '[^0-9a-zA-Z_\-+.]', '_', 'g') as name from supplier")
def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", text.sanitized_name(F.concat("s_name", F.lit(" & co/7b"))).alias("name"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'data/a.b/' || p_partkey || '_filtered.jsonl' when p_partkey % 3 = 1 then 'data/a.b/' || p_partkey || '_filtered' else p_partkey || '.x_filtered.json' end as path from part")
def path_suffix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    p = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("data/a.b/"), k, F.lit(".jsonl"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("data/a.b/"), k)).otherwise(F.concat(k, F.lit(".x.json")))
    return table(spark, d, "part").select("p_partkey", text.with_suffix(p).alias("path"))


@query("select p_partkey, case p_partkey % 4 when 0 then p_size::bigint * 1000000000 when 1 then p_size::bigint * 2 * 1000000 when 2 then -1 else 1500000000 end::bigint as n from part")
def param_count(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Solver-"), s, F.lit("B-it"))).when(k == 1, F.concat(F.lit("s-2x"), s, F.lit("m"))).when(k == 2, "solver").otherwise("s-0.5b-1.5B-300m")
    return table(spark, d, "part").select("p_partkey", text.parameter_count(name).alias("n"))


@query("select p_partkey, (p_size // 7 + case when p_size % 7 > 0 then 1 else 0 end)::bigint as steps, list_max(list_filter(range(1, 9), lambda g: (p_size % g = 0) and (64 % g = 0)))::bigint as gpus, p_partkey // 64 as batch from part")
def step_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numbers.steps(F.col("p_size"), 7).alias("steps"), numbers.gpu_count(F.col("p_size")).cast("long").alias("gpus"), collate.batches(F.col("p_partkey"), 64).alias("batch"))


# Slices, boundaries, formats


@query("select p_partkey, p_name from (select *, row_number() over (order by p_partkey) - 1 as row_id from part) where row_id < 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.first_rows(dense(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "row_id"), 100).drop("row_id")


@query("select p_partkey, p_name from (select *, row_number() over (order by p_partkey) - 1 as row_id from part) where row_id >= 64 and row_id < 128")
def row_slice(spark: SparkSession, d: str) -> DataFrame:
    return splits.slice_rows(dense(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "row_id"), 64, 128).drop("row_id")


@query(_with(fx.COMPLETIONS) + f"select problem_id, gold, a as answer, {rules.number('a')} as strict_value, round({rules.number('a')}, 5) as rounded, {rules.loose_number('a')} as loose_value, count(*) as n from (select problem_id, gold, {rules.last_box('completion')} as a from fx_comp) where a is not null group by all")
def normalize_number(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("answer")
    c = fx.completions(spark, d).select("problem_id", "gold", boxed.last_nested(F.col("completion")).alias("answer")).where("answer is not null").groupBy("problem_id", "gold", "answer").agg(F.count("*").alias("n"))
    return c.select("problem_id", "gold", "answer", numbers.to_number(a).alias("strict_value"), numbers.rounded_number(a).alias("rounded"), numbers.loose_number(a).alias("loose_value"), "n")


@query("select conv_id, turn, conv_id || ' 模型输出：' || left(text, 60) as line from conversations")
def log_line_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.log_line(F.col("conv_id"), text.preview(F.col("text"), 60)).alias("line"))


@query("select item_id, base64(encode(text)) as encoded, 'suite|a|0|0,suite|b' || item_id || '|0|0' as tasks from benchmark")
def encoded_tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.encoded(F.col("text")).alias("encoded"), text.task_list("suite", F.concat(F.lit("a,b"), F.col("item_id").cast("string"))).alias("tasks"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint as n_tokens, -1::bigint as unknown from documents")
def tokenizer_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", external.token_counts("words")(F.col("text")).alias("n_tokens"), external.token_counts("unknown")(F.col("text")).alias("unknown"))


def _answer(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise RuntimeError("refused")
    return f"{prompt}!"


@query(
    "select conv_id, turn, case when role = 'user' then text end as user_content, case when role = 'user' and length(text) % 5 <> 0 then text || '!' end as response, case when role <> 'user' then 'No user message found' when length(text) % 5 = 0 then 'refused' end as error from conversations"
)
def remote_map(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("prompt"))
    return external.remote_map(asked, "prompt", _answer).drop("prompt")


@query("select conv_id, turn, s.k as sample, text || '#' || s.k as output from conversations, (select unnest([0, 1])::integer as k) s where role = 'user'")
def sampled_generation(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return external.generate(asked, "text", lambda ps: [[f"{p}#{k}" for k in range(2)] for p in ps], 2).drop("text")


@query(_LENIENT + f", j as (select case when solution = '' then 'skipped' when contains(completion, 'think') then 'right' when fx_a.a is null then 'skipped' when same then 'right' else 'wrong' end as verdict, case when solution = '' then null when contains(completion, 'think') then 'symbolic' when fx_a.a is not null then 'text' end as method from {_JUDGED}) select verdict, method, count(*) as n from j group by 1, 2")
def symbolic_cascade(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.judged(fx.deep(spark, d), "completion", "solution", check=lambda a, b: True if "think" in a else None)
    return found.groupBy("verdict", "method").agg(F.count("*").alias("n"))


_TURNS = "select conv_id, turn, role, text from conversations"


@query(_TURNS)
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch.folder(spark, "jsonl")
    writers.json_lines(rows, at)
    return readers.json_lines(spark, at, rows.schema)


@query(_TURNS)
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch.folder(spark, "csv")
    writers.csv(rows, at)
    return readers.csv(spark, at, rows.schema)


@query("select cast(row_number() over (order by p_partkey) - 1 as bigint) as row_id, 'part ' || p_partkey as value from part")
def text_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "text")
    writers.log_lines(table(spark, d, "part").orderBy("p_partkey"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")), at, append=False)
    return readers.text_lines(spark, at).select("row_id", "value")


@query("select split, count(*) as n, sum(doc_id)::bigint as ids from (select doc_id, case when pos < floor(n * 0.8) then 'train' when pos < floor(n * 0.9) then 'val' else 'test' end as split from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents)) group by 1")
def cached_splits(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "splits")
    writers.splits(splits.three_way(table(spark, d, "documents").select("doc_id"), "doc_id"), at)
    there = readers.cached(spark, at)
    return sets.concat([rows.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("split", F.lit(name)) for name, rows in there.items()])


@query("select output, count(*) as n, sum(n_chars)::bigint as chars from (select source || '_filtered.jsonl' as output, n_chars from documents where coalesce(n_chars, 0) between 1 and 4096) group by 1")
def filtered_by_source(spark: SparkSession, d: str) -> DataFrame:
    kept = requests.within_usage(table(spark, d, "documents").select("doc_id", "source", "n_chars"), F.col("n_chars"))
    at = scratch.folder(spark, "by-source")
    writers.by_source(kept.withColumn("source_file", F.concat(F.lit("in/"), F.col("source"), F.lit(".jsonl"))).drop("source"), at, root="in")
    return spark.read.schema("doc_id long, n_chars long, output string").json(at).groupBy("output").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select conv_id, turn, role, text from conversations where (conv_id + turn) % 7 <> 0")
def jsonl_skip_bad(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch.folder(spark, "bad-lines")
    line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, '{"conv_id": 1, "te').otherwise(F.to_json(F.struct(*rows.columns)))
    writers.log_lines(rows, line, at, append=False)
    return readers.json_lines(spark, at, rows.schema, bad="skip")


@query("select n_nationkey, n_name from nation")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "nation").select("n_nationkey", "n_name"), scratch.folder(spark, "array")
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(at)
    return readers.json_array(spark, at, rows.schema)


@query("select n_nationkey, n_name, case when n_regionkey < 2 then 'a' else 'b' end as part from nation")
def multi_path_union(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "nation"), scratch.folder(spark, "paths")
    for part, some in (("a", rows.where("n_regionkey < 2")), ("b", rows.where("n_regionkey >= 2"))):
        writers.json_lines(some.select("n_nationkey", "n_name"), f"{at}/{part}")
    found = readers.union_scan(spark, f"{at}/a, {at}/missing, , {at}/b/*.json", rows.select("n_nationkey", "n_name").schema)
    return found.select("n_nationkey", "n_name", F.regexp_extract("source_file", "/(a|b)/[^/]*$", 1).alias("part"))


@query("select r_regionkey::bigint as r_regionkey, r_name || chr(10) || chr(10) || 'end' as value from region")
def whole_text_files(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "whole")
    told = F.concat(F.lit(" \n"), "r_name", F.lit("\n\nend  "))
    table(spark, d, "region").select(F.col("r_regionkey").alias("key"), told.alias("value")).write.partitionBy("key").text(at)
    return readers.whole_text(spark, f"{at}/*/").select(F.regexp_extract("file", r"key=(\d+)", 1).cast("long").alias("r_regionkey"), "value")


@query("select 'request-' || p_partkey as custom_id, p_size::bigint as total_tokens, 'solver' as model, 'assistant' as role, p_name as content from part where p_partkey % 5 <> 0")
def flatten_response(spark: SparkSession, d: str) -> DataFrame:
    message = F.struct(F.lit("assistant").alias("role"), F.col("p_name").alias("content"))
    choices = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<struct<message:struct<role:string,content:string>>>")).otherwise(F.array(F.struct(message.alias("message"))))
    body = F.struct(F.struct(F.col("p_size").cast("long").alias("total_tokens")).alias("usage"), F.lit("solver").alias("model"), choices.alias("choices"))
    rows = table(spark, d, "part").select(F.concat(F.lit("request-"), F.col("p_partkey").cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response"))
    return requests.flatten(rows).select("custom_id", "usage.total_tokens", "model", "message.role", "message.content")


@query(_with(_PAIRS) + f"select case when tok > 128 then 'long' when not ({_PAIR}) or blank then 'malformed' when tok is null and est > 128 then 'long' else 'kept' end as reason, count(*) as n from (select *, case when conv_id % 3 = 0 then conv_id * 10 % 300 end as tok from s) t group by 1")
def skip_reason_tokens(spark: SparkSession, d: str) -> DataFrame:
    samples = conversations.gathered(table(spark, d, "conversations")).withColumn("num_tokens", F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") * 10 % 300))
    return conversations.reason_counts(samples, conversations.skip_reason(F.col("messages"), tokens=F.col("num_tokens"), longest=128))


@query("select count(*) as total, count(*) filter (role = 'user' and length(text) % 5 <> 0) as succeeded, count(*) filter (role <> 'user' or length(text) % 5 = 0) as failed from conversations")
def remote_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return external.outcomes(remote_map(spark, d))


@query("select cast(row_number() over (order by p_partkey) - 1 as bigint) as position, p_partkey from part")
def index_ordered(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "ordered")
    writers.json_lines(table(spark, d, "part").select("p_partkey").repartition(4), at, order="p_partkey")
    return readers.text_lines(spark, at).select(F.col("row_id").alias("position"), F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"))


@query(_with(fx.COMPLETIONS, fx.PROBLEMS) + r"select l_orderkey, l_linenumber, question, nullif(regexp_extract(answer, '####\s*(\d+(?:\.\d+)?)', 1), '') as gold from fx_comp join fx_prob on problem_id = row_id where regexp_matches(completion, '\\boxed\{(-?\d+(?:\.\d+)?)\}') and regexp_matches(answer, '####\s*(\d+(?:\.\d+)?)')")
def answered_with_box(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.concat(F.lit("request-"), F.col(c).cast("string")).alias("custom_id")
    p = fx.problems(spark, d)
    gold = p.select("question", text.marked_answer(F.col("answer")).alias("gold"), "row_id")
    found = joins.answered(fx.completions(spark, d).select(*KEY, ids("problem_id"), "completion"), p.select(ids("row_id"), "question", "row_id"), gold, present=boxed.first_numeric(F.col("completion")).isNotNull())
    return found.select(*KEY, "question", "gold")


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def csv_strings_scan(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "strings")
    writers.csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), at)
    return readers.csv_strings(spark, at)


@query("select p_partkey, p_name from part where p_partkey % 2 = 0")
def glob_load(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "globbed")
    rows = table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 2).alias("odd"))
    rows.write.partitionBy("odd").json(at)
    return readers.load(spark, f"{at}/odd=0/*.json", "p_partkey long, p_name string", kind="jsonl")


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_nationkey < 5")
def arrow_folder_scan(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa
    from pyarrow import fs

    rows, at = table(spark, d, "nation").select("n_nationkey", "n_name").toArrow(), scratch.folder(spark, "arrow")
    system, path = fs.FileSystem.from_uri(at)
    system.create_dir(path)
    for name, opened, part in (("a.arrow", pa.ipc.new_file, rows), ("b.arrow", pa.ipc.new_stream, rows.filter(pa.compute.less(rows["n_nationkey"], 5)))):
        with system.open_output_stream(f"{path}/{name}") as out, opened(out, rows.schema) as w:
            w.write_table(part)
    return readers.columnar(spark, at)


@query("select p_partkey from part where p_partkey % 3 = 1")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "data-set")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("p_partkey") % 3 + 1).cast("int"))
    writers.dump(table(spark, d, "part").select("p_partkey", split.alias("split")), at, "parquet")
    readers.DATASETS["catalogue/parts"] = (at, None, "parquet")
    return readers.dataset(spark, "catalogue/parts", "val").select("p_partkey")


@query("select '[' || string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey) || ']' as value from supplier where s_suppkey % 7 = 0")
def int_array_file(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "int-array")
    writers.int_array(table(spark, d, "supplier").where("s_suppkey % 7 = 0"), "s_suppkey", at)
    return readers.whole_text(spark, at).select("value")


@query("select 'Part ' || p_partkey as problem, case when p_partkey % 11 = 0 then 'nan' else cast(p_size as varchar) end as reference from part where p_partkey % 7 <> 0")
def problem_reference(spark: SparkSession, d: str) -> DataFrame:
    size = prompts.as_text(F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")))
    named = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")))
    return prompts.problem_reference(table(spark, d, "part").select(named.alias("question"), size.alias("ground_truth")))


@query("select conv_id, turn, coalesce(case when turn % 3 = 0 then role end, case when turn % 2 = 0 then 'even' end, '') as first, list_extract(string_split(text, 'e'), -1) as tail, regexp_replace(substr(text, length(role) + 1), '^\\s+|\\s+$', '', 'g') as rest from conversations")
def defaults_and_tails(spark: SparkSession, d: str) -> DataFrame:
    first = prompts.present(F.when(F.col("turn") % 3 == 0, F.col("role")), F.when(F.col("turn") % 2 == 0, "even"))
    return table(spark, d, "conversations").select("conv_id", "turn", first.alias("first"), text.after_last(F.col("text"), "e").alias("tail"), text.after_prompt(F.col("text"), F.col("role")).alias("rest"))


@query(_with(fx.LOG, _SEGMENTS) + "select gsm8k_index, md5(body) as body_md5 from p where mark > 0 and gsm8k_index % 3 = 0")
def selected_segments(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("gsm8k_index")).distinct()
    return logs.selected(logs.segments(fx.log(spark, d)), wanted).select("gsm8k_index", F.md5("body").alias("body_md5"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'x = ' || p_size || chr(10) when 1 then 'last' || chr(10) else '' end as code, p_partkey % 4 <> 1 and (p_size % 10) <> 9 as close from part")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    one = F.concat(F.lit("Try:\n```python\nx = "), size, F.lit("\n```\nor ```sql\nselect 1\n```"))
    code = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat(one, F.lit(" then ```python\nlast\n``` done"))).otherwise("```python\nnever closed")
    numbers_ = F.array(F.col("p_size").cast("double"), F.lit(1.0))
    near = F.when(k % 4 == 1, F.array(F.lit(1.0))).otherwise(F.array(F.col("p_size") + F.when(F.col("p_size") % 10 == 9, 0.5).otherwise(0.25), F.lit(1.0)))
    return table(spark, d, "part").select("p_partkey", text.last_code_block(code).alias("code"), arrays.within(numbers_, near, 0.25).alias("close"))


@query("select conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)), ',') as ids from conversations")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = external.tokenizer(external.word_lengths)(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("select conv_id, turn, role from conversations")
def guarded_union(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.require_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conversations")
    return sets.concat([rows.where("turn % 2 = 0"), rows.where("turn % 2 <> 0")])


_OPEN = "case when xa is not null and xb is not null then xa else a end", "case when xa is not null and xb is not null then xb else b end"


@query(
    _with(fx.DEEP, _BOXES, "pr as (select completion as a, solution as b, count(*) as n from fx_deep group by 1, 2)")
    + f""", op as (select pr.*, list_extract(boxes, -1) as xa, {rules.last_box("b")} as xb from pr join fx_box on a = text),
v as (select a, b, same from {rules.lenient_opened(f"(select distinct {_OPEN[0]} as a, {_OPEN[1]} as b from op)")} z)
select op.a, op.b, same as equal, n from op join v on v.a = {_OPEN[0].replace("else a", "else op.a")} and v.b = {_OPEN[1].replace("else b", "else op.b")}"""
)
def values_equal_v3_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.deep(spark, d).groupBy(F.col("completion").alias("a"), F.col("solution").alias("b")).agg(F.count("*").alias("n"))
    return equivalence.with_lenient(rows, F.col("a"), F.col("b"), "equal", equivalence.balanced_box)


class _Echo:
    """A stand-in for a batch service: answers each request's user message with itself and an exclamation mark."""

    def __init__(self, spark: SparkSession):
        self.spark, self.polls = spark, 0

    def upload(self, path: str) -> str:
        return path

    def create(self, file_id: str) -> str:
        return file_id

    def status(self, job_id: str) -> str:
        self.polls += 1
        return "completed" if self.polls > 2 else "in_progress"

    def files(self, job_id: str) -> tuple[str | None, str | None]:
        return job_id, None

    def download(self, file_id: str, path: str) -> None:
        asked = self.spark.read.json(file_id)
        message = F.struct(F.lit("assistant").alias("role"), F.concat(requests.first_user(F.col("body.messages")), F.lit("!")).alias("content"))
        body = F.struct(F.lit("echo").alias("model"), F.struct(F.lit(1).alias("total_tokens")).alias("usage"), F.array(F.struct(message.alias("message"))).alias("choices"))
        writers.json_lines(asked.select("custom_id", F.struct(body.alias("body")).alias("response")), path)


@query(_with(fx.PROBLEMS) + "select 'request-' || (row_id + 1) as custom_id, question || '!' as content, 'completed' as status from fx_prob")
def batch_job(spark: SparkSession, d: str) -> DataFrame:
    at, out = scratch.folder(spark, "requests"), scratch.folder(spark, "responses")
    writers.json_lines(requests.build(fx.problems(spark, d), F.col("question"), "echo", SYSTEM), at)
    (client,) = jobs.Registry(echo=_Echo).build(["echo"], spark=spark)
    done = jobs.run(client, at, out, f"{out}-errors", sleep=lambda s: None)
    return requests.flatten(spark.read.json(done.output)).select("custom_id", "message.content", F.lit(done.status).alias("status"))


# Files of documents, and records of mixed shape


@query("select doc_id, source, md5('\"' || text || chr(10) || '\",' || lang) as text_md5 from documents")
def csv_documents(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "csv-documents")
    told = F.concat(F.lit('"'), "text", F.lit('\n",'), "lang")
    writers.csv(table(spark, d, "documents").select("doc_id", "source", told.alias("told")), at)
    return readers.csv(spark, at, "doc_id long, source string, told string").select("doc_id", "source", F.md5("told").alias("text_md5"))


@query("select doc_id, md5('}{\"' || text) as text_md5, source as inner_source, n_chars from documents")
def json_array_documents(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "json-documents")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit('}{"'), "text").alias("told"), F.struct("source", F.array(F.struct("n_chars")).alias("sizes")).alias("about"))
    writers.json_array(rows, at)
    return readers.json_array(spark, at, rows.schema).select("doc_id", F.md5("told").alias("text_md5"), F.col("about.source").alias("inner_source"), F.col("about.sizes")[0]["n_chars"].alias("n_chars"))


@query("select doc_id, n_chars from documents")
def arrow_documents(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "arrow-documents")
    writers.arrow_files(table(spark, d, "documents").select("doc_id", "text", "n_chars"), at)
    return readers.arrow_files(spark, at, ["doc_id", "n_chars"])


@query("select p_partkey, p_name from part")
def load_of_lists(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "part").select("p_partkey", "p_name"), scratch.folder(spark, "lists")
    for k in range(3):
        writers.dump(rows.where(F.col("p_partkey") % 4 == k), f"{at}/{k}", "parquet")
    writers.arrow_files(rows.where("p_partkey % 4 = 3"), f"{at}/3")
    return readers.load(spark, [f"{at}/{k}" for k in range(4)], kind="parquet")


@query("select 'request-' || p_partkey as custom_id, 'part ' || (p_partkey % 1000) as question, g.gold from part join (select p_partkey % 1000 as q, max_by(p_size, p_partkey)::varchar as gold from part where p_partkey % 7 <> 0 group by 1) g on q = p_partkey % 1000")
def last_matching_gold(spark: SparkSession, d: str) -> DataFrame:
    """Of a question's answers, of which some have no number, the last that has one counts."""
    p = table(spark, d, "part")
    asked = F.concat(F.lit("part "), (F.col("p_partkey") % 1000).cast("string")).alias("question")
    ids, answer = F.concat(F.lit("request-"), F.col("p_partkey").cast("string")).alias("custom_id"), F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.concat(F.lit("#### "), F.col("p_size").cast("string")))
    answers = p.select(asked, text.marked_answer(answer).alias("gold"), F.col("p_partkey").alias("row_id"))
    return joins.answered(p.select(ids), p.select(ids, asked, F.col("p_partkey").alias("row_id")), answers).select("custom_id", "question", "gold")


@query("select 'in/' || lang || '/data_filtered.jsonl' as output, count(*) as n, sum(doc_id)::bigint as ids from documents where lang is not null group by 1")
def filtered_by_folder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("lang is not null").select("doc_id", F.concat(F.lit("in/"), "lang", F.lit("/data.jsonl")).alias("source_file"))
    at = scratch.folder(spark, "by-folder")
    writers.by_source(rows, at)
    return spark.read.schema("doc_id long, output string").json(at).groupBy("output").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("select 'train' as split, count(*) as n from part union all select 'val', 0")
def cached_empty_split(spark: SparkSession, d: str) -> DataFrame:
    at = scratch.folder(spark, "empty-split")
    writers.splits(table(spark, d, "part").withColumn("split", F.lit("train")), at, names=("train", "val"))
    there = readers.cached(spark, at, ("train", "val"))
    return sets.concat([rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("split"), "n") for name, rows in there.items()])


@query("""select conv_id, turn, case turn % 5 when 0 then text when 1 then 'None' when 2 then 'True' when 3 then '' else conv_id::varchar end as gold,
  turn % 5 = 4 as has_instruction from conversations where conv_id % 11 <> 0""")
def key_presence(spark: SparkSession, d: str) -> DataFrame:
    """Records of five shapes: a text, an explicit null before another field, another field only, neither, a number; and lines that aren't JSON."""
    c, at = table(spark, d, "conversations"), scratch.folder(spark, "shapes")
    ids = F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(', "turn": '), F.col("turn").cast("string"))
    quoted = F.get(F.regexp_extract_all(F.to_json(F.struct("text")), F.lit(r'(?s)^\{"text":(.*)\}$'), F.lit(1)), F.lit(0))
    more = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit(', "reference": '), quoted)).when(F.col("turn") % 5 == 1, ', "reference": null, "answer": "x"')
        .when(F.col("turn") % 5 == 2, ', "answer": true').when(F.col("turn") % 5 == 3, ', "other": {"reference": 1}').otherwise(F.concat(F.lit(', "reference": '), F.col("conv_id").cast("string"), F.lit(', "instruction": null')))
    )
    writers.log_lines(c, F.concat(ids, more, F.when(F.col("conv_id") % 11 == 0, "").otherwise("}")), at, append=False)
    rows = readers.json_records(spark, at).where("record is not null")
    number = lambda n: F.try_variant_get("record", f"$.{n}", "long").alias(n)
    return rows.select(number("conv_id"), number("turn"), records.first_text(F.col("record"), "reference", "answer").alias("gold"), records.has(F.col("record"), "instruction").alias("has_instruction"))


@query("select count(*) as total, count(*) filter ((conv_id + turn) % 7 <> 0 and length(text) <= 80) as kept, count(*) filter ((conv_id + turn) % 7 <> 0 and length(text) > 80) as discarded, count(*) filter ((conv_id + turn) % 7 = 0) as bad, count(*) filter ((conv_id + turn) % 7 <> 0 and length(text) <= 80) as written from conversations")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch.folder(spark, "observed")
    line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, '{"conv_id": 1, "te').otherwise(F.to_json(F.struct(*rows.columns)))
    writers.log_lines(rows, line, f"{at}/in", append=False)
    scan = readers.json_lines(spark, f"{at}/in", rows.schema, bad="keep")
    seen = writers.filtered(scan, F.length("text") <= 80, f"{at}/out", bad=F.col("_corrupt_record").isNotNull())
    written = spark.read.schema(rows.schema).json(f"{at}/out").agg(F.count("*").alias("written"))
    return written.select(*[F.lit(seen[n]).cast("long").alias(n) for n in ("total", "kept", "discarded", "bad")], "written")


@query("select p_partkey, p_name, 'b/' || (p_partkey % 3) as batch from part")
def append_batches_twice(spark: SparkSession, d: str) -> DataFrame:
    rows, at = table(spark, d, "part").select("p_partkey", "p_name"), scratch.folder(spark, "appended")
    for k in (0, 1, 0, 2, 1):
        writers.append_once(rows.where(F.col("p_partkey") % 3 == k), at, f"b/{k}")
    return readers.appended(spark, at, rows.schema)


@query(SQL["remote_map"])
def remote_map_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A first run that is cut off asks a part of the rows; the second one the rest."""
    asked = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("prompt"))
    at = scratch.folder(spark, "ledger")
    remote.mapped_once(asked.where("conv_id % 3 = 0"), "id", "prompt", _answer, at, steps=2)
    return remote.mapped_once(asked, "id", "prompt", _answer, at, steps=2).drop("id", "prompt")


@query("""select conv_id::varchar as response_id, coalesce(string_agg(case when role = 'user' and turn % 4 <> 3 then text end, '' order by turn), '') as reasoning,
  coalesce(string_agg(case when role <> 'user' and turn % 4 <> 3 then text end, '' order by turn), '') as content, count(*) as chunks, true as complete from (select distinct on (conv_id, turn) * from conversations) group by 1""")
def chunk_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as chunks of a response, in two waves of files that a stream reads one after the other."""
    c = table(spark, d, "conversations")
    reasoning, end = F.when(F.col("role") == "user", F.col("text")), F.max("turn").over(Window.partitionBy("conv_id"))
    seq = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    choice = F.struct(reasoning.alias("reasoning"), F.when(F.col("role") != "user", F.col("text")).alias("content"))
    rows = c.select(F.col("conv_id").cast("string").alias("response_id"), seq.cast("long").alias("seq"), F.when(F.col("turn") % 4 == 3, F.array().cast("array<struct<reasoning:string,content:string>>")).otherwise(F.array(choice)).alias("choices"), (F.col("turn") == end).alias("last"))
    at = scratch.folder(spark, "chunks")
    rows.where("seq % 2 = 1").write.json(f"{at}/in/wave=1")
    for _ in range(2):
        chunks.run(spark, f"{at}/in/*", f"{at}/out", f"{at}/checkpoint")
        rows.where("seq % 2 = 0").write.mode("ignore").json(f"{at}/in/wave=2")
    chunks.run(spark, f"{at}/in/*", f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(chunks.RESPONSE).parquet(f"{at}/out")
