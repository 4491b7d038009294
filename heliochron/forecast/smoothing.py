"""Exponential smoothing with the factor chosen on a grid, and the theta method.

A level depends on the level before it, so each series is one fold over its days (at most
36,525 in a century); series and factors run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .baselines import _attach, future_spine

ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def fit_smoothing(history: DataFrame, y: str, ts: str, by: Sequence[str] = (),
                  alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """``(by, alpha, sse, level, n)`` of the factor with the least one-step error (the smaller on ties)."""
    ys = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).cast("double").alias("y")))),
                     lambda s: s["y"])
    g = history.where(F.col(y).isNotNull()).groupBy(*by).agg(ys.alias("__ys"))
    factors = F.array(*[F.lit(float(a)) for a in alphas])

    def step(acc, v):
        """One day for all factors at once."""
        def one(s, a):
            e = v - s["level"]
            return F.struct((s["level"] + a * e).alias("level"), (s["sse"] + e * e).alias("sse"))
        return F.zip_with(acc, factors, one)

    start = F.transform(factors, lambda a: F.struct(F.element_at("__ys", 1).alias("level"), F.lit(0.0).alias("sse")))
    fold = F.aggregate(F.slice("__ys", 2, F.greatest(F.size("__ys"), F.lit(1))), start, step)
    best = F.array_min(F.zip_with(fold, factors, lambda s, a: F.struct(s["sse"].alias("sse"), a.alias("alpha"), s["level"].alias("level"))))
    return g.select(*by, F.size("__ys").alias("n"), best.alias("b")).select(*by, "b.alpha", "b.sse", "b.level", "n")


def forecast_smoothing(history: DataFrame, h: int, y: str = "y", ts: str = "ds", by: Sequence[str] = (),
                       theta: bool = False, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """``(by, lead, ts, yhat)``: flat at the last level, or with half the linear drift (theta)."""
    fit = fit_smoothing(history, y, ts, by, alphas)
    out = _attach(future_spine(history, ts, h, by), fit, by)
    yhat = F.col("level")
    if theta:
        t = F.unix_date(F.col(ts).cast("date")).cast("double")
        slope = history.where(F.col(y).isNotNull()).groupBy(*by).agg(F.regr_slope(F.col(y), t).alias("__b"))
        out = _attach(out, slope, by)
        a, n = F.col("alpha"), F.col("n")
        yhat = yhat + F.coalesce(F.col("__b"), F.lit(0.0)) / 2 * (
            F.col("lead") - 1 + 1 / a - F.pow(1 - a, n.cast("double")) / a)
    return out.select(*by, "lead", ts, yhat.alias("yhat"))
