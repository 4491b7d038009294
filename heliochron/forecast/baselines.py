"""Baseline forecasts: one future row per series and step, from one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import step_interval
from ..operators.ordered import join_keys

BASELINES = ("last", "seasonal", "mean", "clock_hour")


def _ahead(ts: Column, n: Column, step: str) -> Column:
    """``n`` steps after ``ts``."""
    if step == "day":
        return F.date_add(ts.cast("date"), n.cast("int"))
    if step == "hour":
        return ts + F.make_dt_interval(F.lit(0), n.cast("int"))
    raise ValueError(f"unknown step {step!r}")


def future_spine(history: DataFrame, ts: str, h: int, by: Sequence[str] = (), step: str = "day") -> DataFrame:
    """``(by, lead, ts)``: the ``h`` steps after each series' last row."""
    last = history.groupBy(*by).agg(F.max(ts).alias("__last"))
    d = last.select(*by, "__last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("lead"))
    return d.select(*by, "lead", _ahead(F.col("__last"), F.col("lead"), step).alias(ts))


def _attach(spine: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return join_keys(spine, one, list(by))
    return spine.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def baseline(history: DataFrame, name: str, h: int, y: str = "y", ts: str = "ds", by: Sequence[str] = (),
             step: str = "day", season: int = 7) -> DataFrame:
    """``(by, lead, ts, yhat)`` of one of ``BASELINES``."""
    if name in ("last", "mean"):
        v = F.max_by(y, F.when(F.col(y).isNotNull(), F.col(ts))) if name == "last" else F.avg(y)
        one = history.groupBy(*by).agg(F.max(ts).alias("__last"), v.cast("double").alias("yhat"))
        d = one.select(*by, "__last", "yhat", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("lead"))
        return d.select(*by, "lead", _ahead(F.col("__last"), F.col("lead"), step).alias(ts), "yhat")
    spine = future_spine(history, ts, h, by, step)
    if name == "clock_hour":
        known = history.where(F.col(y).isNotNull())
        means = known.groupBy(*by, F.hour(ts).alias("__h")).agg(F.avg(y).alias("yhat"))
        out = join_keys(spine.withColumn("__h", F.hour(ts)), means, [*by, "__h"])
    elif name == "seasonal":
        # lead k repeats the value a whole number of seasons back, the nearest that is known
        back = -F.ceil(F.col("lead") / F.lit(season)) * season
        src = spine.withColumn("__src", _ahead(F.col(ts), back, step))
        vals = history.select(*by, F.col(ts).alias("__src"), F.col(y).alias("yhat"))
        out = join_keys(src, vals, [*by, "__src"])
    else:
        raise ValueError(f"unknown baseline {name!r}")
    return out.select(*by, "lead", ts, F.col("yhat").cast("double").alias("yhat"))


def mean_or_last(history: DataFrame, y: str, ts: str, by: Sequence[str] = (), n: int = 30) -> DataFrame:
    """Per series: mean of the last ``n`` rows, or the last value when there are fewer."""
    from ..operators.ordered import series_window
    r = F.row_number().over(series_window(by, F.col(ts).desc()))
    d = history.select(*by, F.col(ts), F.col(y), r.alias("__r")).where(F.col("__r") <= n)
    return d.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= n, F.avg(y)).otherwise(F.max_by(y, ts)).alias("fallback"))
