"""Boundaries to tokenizers, models, remote services and symbolic checkers: the caller brings the callable.

Each runs in Arrow batches on the executors; an error of one row becomes that row's error and never fails the task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def tokenizer(encode: Callable[[str], list[int]]):
    """Text to token ids; null stays null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(encode(t)))

    return ids


def word_lengths(text: str) -> list[int]:
    """A stand-in tokenizer for tests: each word's length."""
    return [len(w) for w in text.split()]


#: Tokenizers by model name.
TOKENIZERS: dict[str, Callable[[str], list[int]]] = {"words": word_lengths}


def token_counts(name: str):
    """Token counts under a named tokenizer; -1 for all texts if the name is unknown."""
    encode = TOKENIZERS.get(name)

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: -1 if encode is None or t is None else len(encode(t))).astype("int64")

    return counts


def verifier(check: Callable[[str, str], bool | None]):
    """A symbolic comparison of two texts: true, false or null (undecided, also after an error)."""

    @F.pandas_udf(T.BooleanType())
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> bool | None:
            try:
                return None if x is None or y is None else check(x, y)
            except Exception:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return verdict


def generate(rows: DataFrame, prompt: str, model: Callable[[list[str]], Iterable[list[str]]], samples: int = 1, batch: int = 64) -> DataFrame:
    """Each row once per sample, with ``sample`` (from 0) and ``output``; the model gets prompts in batches and gives ``samples`` texts each."""
    schema = T.StructType([*rows.schema.fields, T.StructField("sample", T.IntegerType()), T.StructField("output", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                texts = list(model(some[prompt].tolist()))
                out = some.loc[some.index.repeat([len(t) for t in texts])].reset_index(drop=True)
                yield out.assign(sample=[k for t in texts for k in range(len(t))], output=[x for t in texts for x in t])

    return rows.mapInPandas(run, schema)


def remote_map(rows: DataFrame, prompt: str, call: Callable[[str], str], workers: int | None = None, in_flight: int = 8, retries: int = 0) -> DataFrame:
    """Rows with ``user_content``, ``response`` and ``error``: a null or empty prompt and a failed call give an error, not a lost row.

    A task has at most ``in_flight`` calls under way, and gives rows back in their order as calls end: one that is slow holds up what is given out, not the
    calls behind it, up to that bound. A call that fails is tried ``retries`` times more.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in ("user_content", "response", "error"))])

    def one(text: str | None) -> tuple[str | None, str | None, str | None]:
        if not text:
            return None, None, "No user message found"
        for left in range(retries, -1, -1):
            try:
                return text, call(text), None
            except Exception as e:
                if not left:
                    return text, None, str(e)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for part in parts:
                got, waiting = [], deque()
                for text in part[prompt]:
                    if len(waiting) == in_flight:
                        got.append(waiting.popleft().result())
                    waiting.append(pool.submit(one, text))
                got += [w.result() for w in waiting]
                yield part.assign(**{n: pd.Series([g[i] for g in got], index=part.index, dtype="object") for i, n in enumerate(("user_content", "response", "error"))})

    return (rows.repartition(workers) if workers else rows).mapInPandas(run, schema)


def outcomes(rows: DataFrame, error: str = "error") -> DataFrame:
    """One row: total, succeeded, failed."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"))
