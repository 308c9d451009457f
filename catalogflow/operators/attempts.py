"""W5 attempt selection over an explicit ``attempts`` table
(item, attempt 1..n, content, score).

Attempts run in order and stop after the first scoring >= target, at most
``max_attempts``; the result is the *last executed* attempt (``select='last'``,
parity) or the best executed one (``'best'``).  Both are single aggregates:
``min_by`` over passing attempts and ``max_by`` over all -- partial
aggregation, no window, no per-item sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_attempt(attempts: DataFrame, key: str, attempt: str = "attempt", score: str = "score",
                   target: float = 95, max_attempts: int = 2, select: str = "last") -> DataFrame:
    a = attempts.where(F.col(attempt) <= max_attempts)
    others = [c for c in a.columns if c != key]
    row = F.struct(*[F.col(c) for c in others])
    passed = F.col(score) >= target
    first_pass = F.min_by(row, F.when(passed, F.col(attempt)))
    if select == "last":
        fallback = F.max_by(row, F.col(attempt))
    elif select == "best":
        fallback = F.max_by(row, F.struct(F.col(score), -F.col(attempt)))
    else:
        raise ValueError(f"unknown select {select!r}")
    g = a.groupBy(key).agg(first_pass.alias("_pass"), fallback.alias("_fb"),
                           F.max(F.col(attempt)).alias("_last"))
    chosen = F.coalesce(F.col("_pass"), F.col("_fb"))
    return g.select(key, *[chosen[c].alias(c) for c in others],
                    F.coalesce(F.col("_pass")[attempt], F.col("_last")).alias("attempts_run"))
