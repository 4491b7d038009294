"""Daily series to a scored backtest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecast.backtest import Model, backtest, backtest_baselines, backtest_scores, fold_cells, folds
from ..functions.cells import to_number
from ..functions.times import parse_time
from ..operators.align import align_month_day
from ..operators.clean import find_time_column
from ..operators.features import fill, holdout, naive_lag
from ..operators.profile import infer_numeric
from ..operators.resample import complete
from ..operators.score import compare_models, score_stored
from ..session import cut_lineage
from ..sources.readers import latest_file, read_csv


def model_ready(df: DataFrame, y: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows without a time out, every day present, gaps filled forwards then backwards."""
    d = complete(df.na.drop(subset=[ts]), ts, "day", by)
    return fill(d, [c for c in d.columns if c not in (ts, *by)], ts, by)


def backtest_days(df: DataFrame, models: Mapping[str, Model] | Sequence[str], y: str, ts: str, h: int, k: int = 3,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores) of each model on k folds of h days.

    Baselines given by name need only moments of the train parts; models given as functions get the train rows.
    The daily table is read more than once, so it is written to the shared folder once; the raw
    rows behind it are read a single time.
    """
    days = cut_lineage(model_ready(df, y, ts, by))
    if not isinstance(models, Mapping):
        return backtest_baselines(days, models, y, ts, fold_cells(h, k), by)
    grid = folds(days, ts, h, k, by)
    pred = backtest(grid, models, y, ts, by)
    return pred, backtest_scores(grid, pred, y, ts, by)


def physical_vs_naive(days: DataFrame, physical: DataFrame, h: int, y: str = "y", ts: str = "ds",
                      value: str = "P_mapped_Wh", by: Sequence[str] = ()) -> DataFrame:
    """Scores of a physical model's days and of the day before, on the last ``h`` days.

    The physical series is taken by date, else by the mean of the month-day over its years.
    """
    train, test = holdout(naive_lag(cut_lineage(days.select(*by, ts, y)), y, ts, 1, by, "__naive"), ts, h, by)
    model = align_month_day(physical, test.select(*by, ts), ts, value, by)
    preds = {"physical": model.select(*by, ts, F.col(value).alias("yhat")),
             "naive_lag1": test.select(*by, ts, F.col("__naive").alias("yhat"))}
    return compare_models(test.select(*by, ts, F.col(y).alias("y")), preds, train.select(*by, ts, F.col(y).alias("y")), ts, by)


def score_files(spark, truth_path, forecast_folder: str, pattern: str, date: str = "Date", target: str = "Wh") -> DataFrame | None:
    """Score the newest forecast file that matches against the truth file; None when there is none.

    The truth is filled forwards, then backwards; the forecast's value column is found by name.
    """
    newest = latest_file(spark, forecast_folder, pattern)
    if newest is None:
        return None
    day = lambda df: parse_time(F.col(f"`{find_time_column(df) or df.columns[0]}`")).cast("date").alias(date)
    t = read_csv(spark, truth_path)
    t = t.select(day(t), to_number(F.col(target)).alias("y")).where(F.col(date).isNotNull())
    f = read_csv(spark, newest)
    col = next((c for c in ("Wh_pred", target) if c in f.columns), None)
    col = col or next(iter(infer_numeric(f, f.columns[1:])), f.columns[-1])
    f = f.select(day(f), to_number(F.col(f"`{col}`")).alias("yhat")).where(F.col(date).isNotNull())
    return score_stored(f, fill(t, ["y"], date), ts=date)
