"""A year-long forecast: chunk by chunk, gaps filled, with its naive companion and totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecast.backtest import forecast_in_chunks
from ..forecast.baselines import future_spine
from ..operators.features import fill_trailing_mean, naive_carry
from ..operators.ordered import join_keys
from ..operators.resample import energy_total
from ..operators.scaling import clip_zero
from ..session import cut_lineage, union_all


def fill_forecast(history: DataFrame, forecast: DataFrame, h: int, y: str = "y", ts: str = "ds",
                  by: Sequence[str] = ()) -> DataFrame:
    """The ``h`` days after the history; days the forecast lacks take the trailing mean of 30."""
    days = join_keys(future_spine(history, ts, h, by), forecast.select(*by, ts, "yhat"), [*by, ts])
    both = union_all([history.select(*by, ts, F.col(y).cast("double").alias("v"), F.lit(0).alias("lead")),
                      days.select(*by, ts, F.col("yhat").alias("v"), "lead")])
    return fill_trailing_mean(both, "v", ts, by, only=F.col("lead") > 0).where("lead > 0").select(*by, "lead", ts, F.col("v").alias("yhat"))


def year_ahead(history: DataFrame, model: Callable[[DataFrame, int], DataFrame], h: int = 365, step: int = 90,
               y: str = "y", ts: str = "ds", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(forecast without negatives or gaps, total per series)."""
    raw = forecast_in_chunks(history, model, h, step, y, ts, by)
    out = fill_forecast(history, raw, h, y, ts, by)
    out = cut_lineage(out.select(*by, "lead", ts, clip_zero(F.col("yhat")).alias("yhat")))
    return out, energy_total(out, ts, "yhat", by)


def beside_naive(forecast: DataFrame, truth: DataFrame, y: str = "y", ts: str = "ds",
                 by: Sequence[str] = ()) -> DataFrame:
    """Forecast, the truth where it is known, and the last known truth before each day."""
    first = forecast.groupBy(*by).agg(F.min(ts).alias("__first"))
    keys = union_all([truth.select(*by, ts), forecast.select(*by, ts)]).distinct()
    d = join_keys(join_keys(keys, truth.select(*by, ts, y), [*by, ts]), forecast.select(*by, ts, "yhat"), [*by, ts])
    d = naive_carry(d, y, ts, by, "naive")
    if by:
        d = join_keys(d, first, list(by))
    else:
        d = d.withColumn("__first", first.select("__first").scalar())
    return d.where((F.col(ts) >= F.col("__first")) & F.col("yhat").isNotNull()).drop("__first")
