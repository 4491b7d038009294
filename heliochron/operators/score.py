"""Forecast scores, one row per series (and model, fold, horizon)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import union_all
from .ordered import join_keys, series_window


def score_columns(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates over complete (y, p) pairs; undefined ratios are missing."""
    ok = y.isNotNull() & p.isNotNull()
    y, p = F.when(ok, y.cast("double")), F.when(ok, p.cast("double"))
    e = p - y
    mae, rmse, level = F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), F.avg(y)
    nz = F.when(level != 0, level)
    size = F.abs(y) + F.abs(p)
    return {
        "n": F.count(e),
        "mae": mae,
        "rmse": rmse,
        "nmae": mae / nz,
        "nrmse": rmse / nz,
        "mape": F.avg(F.when(F.abs(y) > 1e-9, F.abs(e) / F.abs(y))) * 100,
        "smape": F.avg(2.0 * F.abs(e) / (size + 1e-9)) * 100,
        "r2": 1 - F.try_divide(F.avg(e * e), F.var_pop(y)),
    }


def smape_skip(y: Column, p: Column) -> Column:
    """SMAPE % over the rows where |y| + |p| is not zero."""
    size = F.abs(y) + F.abs(p)
    return F.avg(F.when(size != 0, 2.0 * F.abs(p - y) / size)) * 100


def smape_fraction(y: Column, p: Column) -> Column:
    """SMAPE as a fraction, rows with |y| + |p| = 0 counting as 0."""
    size = F.abs(y) + F.abs(p)
    return F.avg(F.when(size.isNotNull(), F.coalesce(F.try_divide(2.0 * F.abs(p - y), size), F.lit(0.0))))


def naive_scale(train: DataFrame, y: str, ts: str, by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """Mean absolute and root mean square ``lag`` difference of the train rows, missing when 0."""
    d = F.col(y) - F.lag(y, lag).over(series_window(by, ts))
    g = train.select(*by, d.alias("__d")).groupBy(*by).agg(
        F.avg(F.abs("__d")).alias("mae"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmse"))
    return g.select(*by, F.when(F.col("mae") != 0, F.col("mae")).alias("naive_mae"),
                    F.when(F.col("rmse") != 0, F.col("rmse")).alias("naive_rmse"))


def _beside(df: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return join_keys(df, one, list(by))
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def scores(pred: DataFrame, train: DataFrame, y: str = "y", yhat: str = "yhat", ts: str = "ds",
           by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """MAE, MASE, RMSE, RMSSE, nMAE, nRMSE, MAPE, SMAPE and R2.

    ``by`` are the series keys that prediction and train share; ``extra`` further keys of the
    prediction alone (model, fold, horizon).
    """
    keys = [*by, *extra]
    g = pred.groupBy(*keys).agg(*[c.alias(n) for n, c in score_columns(F.col(y), F.col(yhat)).items()])
    d = _beside(g, naive_scale(train, y, ts, by), by)
    return d.select(*keys, "n", "mae", (F.col("mae") / F.col("naive_mae")).alias("mase_lag1"), "rmse",
                    (F.col("rmse") / F.col("naive_rmse")).alias("rmsse"),
                    "nmae", "nrmse", "mape", "smape", "r2")


def mase_seasonal(pred: DataFrame, train: DataFrame, lag: int = 365, y: str = "y", yhat: str = "yhat",
                  ts: str = "ds", by: Sequence[str] = ()) -> DataFrame:
    """MASE against the ``lag`` difference of train; missing unless train is longer than that."""
    g = pred.groupBy(*by).agg(F.avg(F.abs(F.col(yhat) - F.col(y))).alias("mae"))
    d = _beside(g, naive_scale(train, y, ts, by, lag), by)
    return d.select(*by, "mae", (F.col("mae") / F.col("naive_mae")).alias(f"mase_lag{lag}"))


def scores_on_window(df: DataFrame, y: str, yhat: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Hourly form: the scale is the lag-1 error on the scored window itself.

    ``df`` is the whole series with a forecast only where it is to be scored.
    """
    d = df.select(*by, F.col(y).alias("y"), F.col(yhat).alias("p"),
                  F.lag(y).over(series_window(by, ts)).alias("before")).where("p IS NOT NULL")
    v, p = F.col("y"), F.col("p")
    mae, naive = F.avg(F.abs(v - p)), F.avg(F.abs(F.col("before") - v))
    return d.groupBy(*by).agg(
        mae.alias("mae"), F.when(naive != 0, F.try_divide(mae, naive)).alias("mase"),
        (1 - F.try_divide(F.avg((v - p) * (v - p)), F.var_pop(v))).alias("r2"),
        smape_fraction(v, p).alias("smape"))


def compare_models(y: DataFrame, preds: dict[str, DataFrame], train: DataFrame, ts: str = "ds",
                   by: Sequence[str] = ()) -> DataFrame:
    """One score pass over several predictions ``(by, ts, yhat)`` of the same truth."""
    parts = [p.select(*by, ts, "yhat", F.lit(m).alias("model")) for m, p in preds.items()]
    return scores(y.join(union_all(parts), [*by, ts]), train, ts=ts, by=by, extra=["model"])


def score_stored(forecast: DataFrame, truth: DataFrame, y: str = "y", yhat: str = "yhat", ts: str = "ds",
                 by: Sequence[str] = ()) -> DataFrame:
    """Score a stored forecast on the dates it shares with the truth.

    Train is the truth before the first shared date, or all of it when nothing lies before.
    """
    both = forecast.select(*by, ts, yhat).join(truth.select(*by, ts, y), [*by, ts], "inner")
    first = both.groupBy(*by).agg(F.min(ts).alias("__first"))
    t = _beside(truth.select(*by, ts, y), first, by).where("__first IS NOT NULL")
    start = F.min(ts).over(series_window(by, ts))
    t = t.withColumn("__start", start).where((F.col("__start") >= F.col("__first")) | (F.col(ts) < F.col("__first")))
    return scores(both, t, y, yhat, ts, by)


def score_all(pred: DataFrame, train: DataFrame, variable: str = "variable", y: str = "y", yhat: str = "yhat",
              ts: str = "ds") -> DataFrame:
    """``column, n_train, n_valid, MASE, SMAPE, R2`` per variable, zero denominators skipped."""
    v, p = F.col(y), F.col(yhat)
    ok = pred.where(v.isNotNull() & p.isNotNull())
    g = ok.groupBy(variable).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(F.abs(v - p)).alias("__mae"),
        smape_skip(v, p).alias("SMAPE"), (1 - F.try_divide(F.avg((v - p) * (v - p)), F.var_pop(v))).alias("R2"))
    n = train.groupBy(variable).agg(F.count(F.lit(1)).alias("n_train"))
    d = join_keys(join_keys(g, n, [variable]), naive_scale(train, y, ts, [variable]), [variable])
    return d.select(F.col(variable).alias("column"), "n_train", "n_valid",
                    (F.col("__mae") / F.col("naive_mae")).alias("MASE"), "SMAPE", "R2")
