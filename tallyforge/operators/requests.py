"""Requests to a batch service, its responses, and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.text import model_label


def build(problems: DataFrame, text: Column, model: str, system: str, order: str = "row_id", endpoint: str = "/v1/chat/completions") -> DataFrame:
    """custom_id, method, url, body. Ids count all problems from 1, so those without text leave gaps."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", text)).alias("messages"))
    ids = F.concat(F.lit("request-"), (F.col(order) + 1).cast("string"))
    return problems.where(text.isNotNull()).select(ids.alias("custom_id"), F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body"))


def flatten(responses: DataFrame) -> DataFrame:
    """custom_id, usage, model, message of service responses; a response without a choice is left out."""
    inner = F.col("response.body")
    rows = responses.select("custom_id", inner["usage"].alias("usage"), inner["model"].alias("model"), F.get(inner["choices"], F.lit(0))["message"].alias("message"))
    return rows.where(F.col("message").isNotNull())


def first_user(messages: Column) -> Column:
    """The first user message's content."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]


def usage(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.struct(prompt_tokens.alias("prompt_tokens"), completion_tokens.alias("completion_tokens"), (prompt_tokens + completion_tokens).alias("total_tokens"))


def prediction(index: Column, question: Column, used: Column, path: Column, tuned: Column, reasoning: Column, content: Column) -> list[Column]:
    """Columns of an inference record."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"), reasoning.alias("reasoning_content"))
    return [F.concat(F.lit("request-"), index.cast("string")).alias("custom_id"), question.alias("question"), used.alias("usage"), model_label(path, tuned).alias("model"), message.alias("message")]


def within_usage(rows: DataFrame, tokens: Column, most: int = 4096) -> DataFrame:
    """Rows with 1 to ``most`` tokens; unknown usage counts as 0."""
    return rows.where(F.coalesce(tokens, F.lit(0)).between(1, most))


def usage_counts(rows: DataFrame, tokens: Column, most: int = 4096) -> DataFrame:
    """One row: total, kept, discarded."""
    keep = F.coalesce(tokens, F.lit(0)).between(1, most)
    return rows.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("discarded"))
