"""Shapes of conversations: messages of turns, filters, reasons to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.numbers import token_estimate
from tallyforge.functions.text import is_blank

LONGEST = 4096


def gathered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, messages: turns in order of (turn, role, content)."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return turns.groupBy(conversation).agg(F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def first_user(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, content of its first user turn; partial minima, so a long conversation doesn't gather."""
    return turns.where(F.col(role) == "user").groupBy(conversation).agg(F.min(F.struct(F.col(turn), F.col(text)))[text].alias("content"))


def is_pair(messages: Column) -> Column:
    """Exactly a user and then an assistant message."""
    part = lambda i: F.get(messages, F.lit(i))["role"]
    return F.coalesce((F.size(messages) == 2) & (part(0) == "user") & (part(1) == "assistant"), F.lit(False))


def skip_reason(messages: Column, tokens: Column | None = None, longest: int = LONGEST) -> Column:
    """Why a sample is left out, or null: ``long`` or ``malformed``, tested in this order: known tokens, shape, blank content, and
    estimated tokens where none are known."""
    content = lambda i: F.coalesce(F.get(messages, F.lit(i))["content"], F.lit(""))
    known = F.lit(None).cast("long") if tokens is None else tokens
    return (
        F.when(known > longest, "long")
        .when(~is_pair(messages), "malformed")
        .when(is_blank(content(0)) | is_blank(content(1)), "malformed")
        .when(known.isNull() & (token_estimate(content(0), content(1)) > longest), "long")
    )


def reason_counts(samples: DataFrame, reason: Column) -> DataFrame:
    """reason (``kept`` for none), n."""
    return samples.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def require_rows(df: DataFrame, what: str = "data set") -> DataFrame:
    """The table, or ValueError if it is empty."""
    if df.isEmpty():
        raise ValueError(f"empty {what}")
    return df
