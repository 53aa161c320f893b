"""Prompts, messages and supervised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import boxed
from tallyforge.functions.text import is_blank


def chatml(system: str, user: Column) -> Column:
    """A prompt that ends where the assistant begins."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(user: Column, system: Column | None = None, assistant: Column | None = None) -> Column:
    """An array of messages; a null or empty system prompt is left out."""
    parts = [] if system is None else [F.when(F.coalesce(system, F.lit("")) != "", message("system", system))]
    parts.append(message("user", user))
    if assistant is not None:
        parts.append(message("assistant", assistant))
    return F.array_compact(F.array(*parts))


def with_reasoning(reasoning: Column, content: Column) -> Column:
    """Reasoning, a rule, and the answer."""
    return F.concat(F.coalesce(reasoning, F.lit("")), F.lit("\n\n---\n"), content)


def supervised(rows: DataFrame, question: Column, reasoning: Column, content: Column, system: str, end: str) -> DataFrame:
    """instruction, input, output: a prompt with its target and end mark; rows with an empty question or answer are left out."""
    full = rows.where((F.coalesce(F.length(question), F.lit(0)) > 0) & (F.coalesce(F.length(content), F.lit(0)) > 0))
    return full.select(F.lit(system).alias("instruction"), question.alias("input"), F.concat(with_reasoning(reasoning, content), F.lit(end)).alias("output"))


def problem_reference(rows: DataFrame, question: str = "question", truth: str = "ground_truth") -> DataFrame:
    """problem, reference: renamed, with blanks left out."""
    out = rows.select(F.col(question).alias("problem"), F.col(truth).alias("reference"))
    return out.where(~is_blank(F.coalesce("problem", F.lit(""))) & ~is_blank(F.coalesce(F.col("reference").cast("string"), F.lit(""))))


def problem_solution(rows: DataFrame, question: str = "question", content: str = "content") -> DataFrame:
    """problem, solution: the first box of the content; rows without a problem or a solution are left out."""
    out = rows.select(F.col(question).alias("problem"), boxed.first_nested(F.col(content)).alias("solution"))
    return out.where((F.length("problem") > 0) & F.col("solution").isNotNull())  # a box is never empty


def as_text(value: Column) -> Column:
    """A value as text, ``nan`` where there is none."""
    return F.coalesce(value.cast("string"), F.lit("nan"))


def present(*values: Column) -> Column:
    """The first that isn't null, else the empty string."""
    return F.coalesce(*values, F.lit(""))
