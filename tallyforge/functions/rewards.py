"""Scores of completions as column expressions, and a registry of them by name."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tallyforge.functions import boxed, equivalence
from tallyforge.functions.arrays import ngrams
from tallyforge.functions.numbers import let
from tallyforge.functions.text import count_of

#: The shape of a tagged answer. The start is the text's; the end may be before any line break.
FORMAT = r"(?smd)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$"
#: Tags that count once each, and marks of a reasoning step.
TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")
STEP = r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"


def tagged(completion: Column) -> Column:
    """1 for think and answer tags in their lines, else 0."""
    return F.when(completion.rlike(FORMAT), F.lit(1.0)).otherwise(F.lit(0.0))


def tag_count(completion: Column) -> Column:
    """A quarter for each tag that occurs exactly once."""
    total = F.lit(0.0)
    for tag in TAGS:
        total = total + F.when(count_of(completion, tag) == 1, F.lit(0.25)).otherwise(F.lit(0.0))
    return total


def reasoning_steps(completion: Column) -> Column:
    """A third for each mark of a step, 1 at most; null for null (``least`` alone would give 1)."""
    return F.when(completion.isNotNull(), F.least(F.lit(1.0), F.regexp_count(completion, F.lit(STEP)) / F.lit(3.0)))


def length(size: Column, correct: Column, low: Column, high: Column) -> Column:
    """Between the sizes of a batch: 0.5 for the shortest to -0.5 for the longest, not above 0 if wrong; 0 for all if lengths are equal.

    A null verdict (no gold answer to compare) counts as correct. ``scoring.with_bounds`` finds the bounds.
    """
    value = F.lit(0.5) - (size - low) / F.nullif((high - low).cast("double"), F.lit(0.0))
    return F.when(high == low, F.lit(0.0)).when(F.coalesce(correct, F.lit(True)), value).otherwise(F.least(F.lit(0.0), value))


@dataclass(frozen=True)
class Cosine:
    """Bounds of the cosine score and the length of half a turn. Longer texts turn on; they aren't clamped."""

    min_wrong: float = 0.0
    max_wrong: float = -0.5
    min_correct: float = 0.5
    max_correct: float = 1.0
    max_len: int = 1000

    def __call__(self, size: Column, correct: Column) -> Column:
        """Null verdict (no gold answer): 1."""
        turn = F.lit(1.0) + F.cos(size / F.lit(float(self.max_len)) * F.lit(math.pi))
        between = lambda low, high: F.lit(low) + F.lit(0.5 * (high - low)) * turn
        return F.when(correct.isNull(), F.lit(1.0)).when(correct, between(self.min_correct, self.max_correct)).otherwise(between(self.max_wrong, self.min_wrong))


def repetition(completion: Column, n: int = 3, penalty: float = -1.0) -> Column:
    """The share of n-grams that repeat earlier ones, times the penalty; 0 for fewer than n words."""
    if penalty > 0:
        raise ValueError(f"penalty {penalty} should not be positive")
    return let(ngrams(completion, n), lambda g: F.when(F.size(g) > 0, (F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g)) * F.lit(penalty)).otherwise(F.lit(0.0)))


def repetition_batches(n: int = 3, penalty: float = -1.0):
    """``repetition`` in Arrow batches: the faster form for long texts."""
    if penalty > 0:
        raise ValueError(f"penalty {penalty} should not be positive")

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> float | None:
            if text is None:
                return None
            w = text.lower().split()
            grams = list(zip(*(w[i:] for i in range(n)), strict=False))
            return (1 - len(set(grams)) / len(grams)) * penalty if grams else 0.0

        return texts.map(one).astype("float64")

    return score


def overlong(tokens: Column, longest: int = 16_384, soft: int = 4_096) -> Column:
    """0 up to ``longest - soft`` tokens, then down to -1 at ``longest``, and -1 beyond."""
    return F.when(tokens <= longest - soft, F.lit(0.0)).when(tokens <= longest, (F.lit(longest - soft) - tokens) / F.lit(float(soft))).otherwise(F.lit(-1.0))


def accuracy(completion: Column, solution: Column, last_box: Callable[[Column], Column] = equivalence.balanced_box, verified: Column | None = None) -> Column:
    """1 or 0 for the last box against the solution; null without a box. ``verified``, where it isn't null, decides instead."""
    box = last_box(completion)
    own = F.when(box.isNotNull(), equivalence.lenient(box, solution, last_box).cast("double"))
    return own if verified is None else F.coalesce(verified.cast("double"), own)


def composite(completion: Column, answer: Column) -> Column:
    """0 without a box in the answer, without exactly one ``---`` or without a box in the completion; else 2 if right, 0.2 if wrong.

    Where one answer counts for a whole batch, ``scoring.with_batch_answer`` finds it.
    """

    def score(v: Column) -> Column:
        usable = v["gold"].isNotNull() & v["mine"].isNotNull() & v["ruled"]
        return F.when(F.coalesce(usable, F.lit(False)), F.when(equivalence.loose(v["mine"], v["gold"]), F.lit(2.0)).otherwise(F.lit(0.2))).otherwise(F.lit(0.0))

    parts = F.struct(boxed.last_balanced(answer).alias("gold"), boxed.last_balanced(completion).alias("mine"), (count_of(completion, "---") == 1).alias("ruled"))
    return let(parts, score)


#: Weights of a combined score.
WEIGHTS = {"accuracy": 1.0, "reasoning_steps": 0.2, "repetition_penalty": 0.4}


def weighted(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum; null scores are left out, and the sum of none is null."""
    weights = WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(scores[name] * F.lit(weight), F.lit(0.0))
    return F.when(F.coalesce(*[scores[n] for n in weights]).isNotNull(), total)


@dataclass(frozen=True)
class Fields:
    """Columns that scores read."""

    completion: str = "completion"
    solution: str = "solution"
    tokens: str = "n_tokens"
    correct: str = "correct"
    low: str = "low"
    high: str = "high"


#: Scores by name: (fields, parameters) -> column.
REGISTRY: dict[str, Callable[..., Column]] = {
    "accuracy": lambda f, **p: accuracy(F.col(f.completion), F.col(f.solution), **p),
    "format": lambda f, **p: tagged(F.col(f.completion)),
    "tag_count": lambda f, **p: tag_count(F.col(f.completion)),
    "reasoning_steps": lambda f, **p: reasoning_steps(F.col(f.completion)),
    "length": lambda f, **p: length(F.length(f.completion), F.col(f.correct), F.col(f.low), F.col(f.high)),
    "cosine": lambda f, **p: Cosine(**p)(F.length(f.completion), F.col(f.correct)),
    "repetition_penalty": lambda f, **p: repetition(F.col(f.completion), **p),
    "soft_overlong_punishment": lambda f, **p: overlong(F.col(f.tokens), **p),
}


def selected(names: list[str], fields: Fields = Fields(), parameters: dict[str, dict] | None = None) -> dict[str, Column]:  # noqa: B008
    """Columns of the named scores; an unknown name raises ValueError."""
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown scores {unknown}; known are {sorted(REGISTRY)}")
    return {n: REGISTRY[n](fields, **(parameters or {}).get(n, {})) for n in names}
