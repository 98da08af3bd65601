"""Reward column functions (R1-R4) and the user reward surface."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col


def format_reward(completion) -> Column:
    """Points for each of the four tags present (case-sensitive).

    Summed left to right from 0.0 so the double rounding is the usual one
    (three tags give 0.6000000000000001).
    """
    c = _col(completion)
    pts = F.lit(fixed.FORMAT_TAG_POINTS)
    total = F.lit(0.0)
    for tag in (fixed.THINK_OPEN, fixed.THINK_CLOSE, fixed.ANSWER_OPEN, fixed.ANSWER_CLOSE):
        total = total + F.when(c.contains(tag), pts).otherwise(F.lit(0.0))
    return total


def correctness_consistency_reward(pred_think, pred_answer, answer_ok, think_ok,
                                   answer_words) -> Column:
    """R2 on prepared columns.

    Empty answer: 0.0.  Wrong: -1.0.  Correct: 2.0, then +0.5 / -0.5 when the
    think part is non-empty and (in)consistent, then -0.5 when the answer has
    more than three words.
    """
    think, ans = _col(pred_think), _col(pred_answer)
    consistency = (F.when(think != F.lit(""),
                          F.when(_col(think_ok), F.lit(fixed.CONSISTENT_BONUS))
                          .otherwise(F.lit(-fixed.INCONSISTENT_PENALTY)))
                   .otherwise(F.lit(0.0)))
    long_penalty = (F.when(_col(answer_words) > F.lit(fixed.LONG_ANSWER_WORDS),
                           F.lit(fixed.LONG_ANSWER_PENALTY)).otherwise(F.lit(0.0)))
    return (F.when(ans == F.lit(""), F.lit(fixed.EMPTY_ANSWER_POINTS))
            .when(~_col(answer_ok), F.lit(fixed.WRONG_POINTS))
            .otherwise(F.lit(fixed.CORRECT_POINTS) + consistency - long_penalty))


def combined_reward(format_col, main_col) -> Column:
    """R1 + R2 in double, delivered as float32."""
    return (_col(format_col) + _col(main_col)).cast("float")


# ---------------------------------------------------------------- R4 / U1

RewardFn = Callable[[], Column]


class RewardRegistry:
    """Named reward columns combined with weights.

    A reward is a zero-argument callable returning a ``Column`` over the
    scored table (so it stays a Catalyst expression), or a ``Column``.
    """

    def __init__(self):
        self._rewards: dict[str, Callable[[], Column]] = {}

    def register(self, name: str, reward) -> "RewardRegistry":
        self._rewards[name] = reward if callable(reward) else (lambda r=reward: r)
        return self

    def names(self) -> list[str]:
        return list(self._rewards)

    def column(self, name: str) -> Column:
        return self._rewards[name]()

    def total(self, weights: Mapping[str, float] | None = None) -> Column:
        """Weighted sum, left to right in registration order, as float32."""
        weights = weights or {n: 1.0 for n in self._rewards}
        expr = F.lit(0.0)
        for name in self._rewards:
            if name in weights:
                w = weights[name]
                term = self.column(name).cast("double")
                expr = expr + (term if w == 1.0 else term * F.lit(float(w)))
        return expr.cast("float")


def default_registry() -> RewardRegistry:
    """The two built-in rewards over a table scored by ``score_completions``."""
    return (RewardRegistry()
            .register("format", lambda: F.col("format_reward"))
            .register("correctness_consistency", lambda: F.col("main_reward")))


def python_reward(fn: Callable[..., object], completion="completion", **columns) -> Column:
    """Run a user reward ``fn(completions: list[str], **columns)`` in
    Arrow batches (pandas UDF), returning float32.

    Extra dataset columns reach ``fn`` as keyword lists, as a trainer would
    pass them.  This is the slow path; built-in rewards stay Catalyst.
    """
    from pyspark.sql import SparkSession

    from ..session import ship_package

    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
    names = list(columns)

    def _run(comp: pd.Series, extra: pd.DataFrame | None) -> pd.Series:
        kwargs = {n: extra[n].tolist() for n in names} if extra is not None else {}
        out = fn(comp.fillna("").tolist(), **kwargs)
        if hasattr(out, "detach"):
            out = out.detach().cpu().numpy()
        return pd.Series(np.asarray(out, dtype=np.float32))

    if names:
        @F.pandas_udf("float")
        def _call(comp: pd.Series, extra: pd.DataFrame) -> pd.Series:
            return _run(comp, extra)
        return _call(_col(completion), F.struct(*[_col(c).alias(n) for n, c in columns.items()]))

    @F.pandas_udf("float")
    def _call1(comp: pd.Series) -> pd.Series:
        return _run(comp, None)
    return _call1(_col(completion))
