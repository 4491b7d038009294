"""Backtest grid over series, model, fold and horizon; ensembles, intervals, ranks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import align
from ..operators.features import fill, rows_left, series_length
from ..operators.ordered import join_keys, series_window
from ..operators.score import score_columns, scores
from ..session import cut_lineage, union_all
from .baselines import _attach, future_spine, mean_or_last

HORIZONS = (120, 90, 60, 30)


def folds(df: DataFrame, ts: str, h: int, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Each row once per fold it belongs to, with ``fold`` and ``role`` (train or test).

    Fold i ends ``i*h`` rows before the end and tests the ``h`` rows after that; a fold needs a
    train part at least as long as its test part.
    """
    d = df.select("*", rows_left(ts, by).alias("__r"), series_length(by).alias("__n"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    start = (F.col("fold") - 1) * h
    d = d.where((F.col("__r") >= start) & (F.col("__n") - F.col("fold") * h >= h))
    role = F.when(F.col("__r") < F.col("fold") * h, "test").otherwise("train")
    return d.select(*df.columns, "fold", role.alias("role"))


def horizons(df: DataFrame, ts: str, hs: Sequence[int] = HORIZONS, by: Sequence[str] = ()) -> DataFrame:
    """Each row once per horizon with ``horizon`` and ``role``; series too short for one skip it."""
    d = df.select("*", rows_left(ts, by).alias("__r"), series_length(by).alias("__n"))
    # a generator in the same projection would be run before the windows
    d = d.select("*", F.explode(F.array(*[F.lit(int(h)) for h in hs])).alias("horizon"))
    d = d.where(F.col("__n") > F.col("horizon"))
    role = F.when(F.col("__r") < F.col("horizon"), "test").otherwise("train")
    return d.select(*df.columns, "horizon", role.alias("role"))


def fold_cells(h: int, k: int = 3) -> list[tuple[int, int, int]]:
    """(fold, start, cut): tests on the rows ``start`` to ``cut`` before the end; see :func:`folds`."""
    return [(i, (i - 1) * h, i * h) for i in range(1, k + 1)]


def horizon_cells(hs: Sequence[int] = HORIZONS) -> list[tuple[int, int, int]]:
    """(horizon, 0, horizon); see :func:`horizons`."""
    return [(int(h), 0, int(h)) for h in hs]


def _cells(cells: Sequence[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(int(c)).alias("cell"), F.lit(int(a)).alias("start"), F.lit(int(b)).alias("cut")) for c, a, b in cells])


def _enough(cells: Sequence[tuple[int, int, int]], key: str) -> Callable[[Column], Column]:
    """A fold needs a train part at least as long as its test part, a horizon any."""
    return lambda c: F.col("__n") - c["cut"] >= (c["cut"] - c["start"] if key == "fold" else F.lit(1))


def train_moments(df: DataFrame, y: str, ts: str, cells: Sequence[tuple[int, int, int]], by: Sequence[str] = (), key: str = "fold") -> DataFrame:
    """``(by, key, last_ts, last, mean, naive_mae, naive_rmse)`` of the train part of every cell, no row twice.

    The cuts part a series into blocks.  One aggregate gives each block's count, mean, last value and sums of lag-1
    errors; a cell's train part is the blocks before its cut, and theirs are added up.  A row's lag-1
    error refers to an older row, so it belongs to every train part that has the row.
    """
    cuts = sorted({b for *_, b in cells})
    w = series_window(by, ts)
    d = df.select(*by, F.col(ts).alias("__t"), F.col(y).cast("double").alias("__y"), rows_left(ts, by).alias("__r"), series_length(by).alias("__n"),
                  (F.col(y) - F.lag(y).over(w)).cast("double").alias("__d"))
    at = sum((F.col("__r") >= c).cast("int") for c in cuts)
    v, e = F.col("__y"), F.col("__d")
    blocks = d.groupBy(*by, at.alias("__block")).agg(
        F.max("__n").alias("__n"), F.max("__t").alias("__t"), F.count(v).alias("__k"), F.avg(v).alias("__m"), F.max(F.when(v.isNotNull(), F.struct("__t", "__y"))).alias("__last"),
        F.count(e).alias("__e"), F.sum(F.abs(e)).alias("__abs"), F.sum(e * e).alias("__sq"))
    block_of = F.create_map(*[F.lit(x) for i, c in enumerate(cuts) for x in (c, i + 1)])
    enough = _enough(cells, key)
    mine = F.filter(_cells(cells), lambda c: enough(c) & (F.col("__block") >= F.element_at(block_of, c["cut"])))
    g = blocks.select("*", F.explode(mine).alias("__c")).groupBy(*by, F.col("__c.cell").alias(key)).agg(
        F.max("__t").alias("last_ts"), F.max("__last")["__y"].alias("last"), F.try_divide(F.sum(F.col("__m") * F.col("__k")), F.sum("__k")).alias("mean"),
        F.try_divide(F.sum("__abs"), F.sum("__e")).alias("__a"), F.sqrt(F.try_divide(F.sum("__sq"), F.sum("__e"))).alias("__b"))
    return g.select(*by, key, "last_ts", "last", "mean", F.when(F.col("__a") != 0, F.col("__a")).alias("naive_mae"), F.when(F.col("__b") != 0, F.col("__b")).alias("naive_rmse"))


def test_rows(df: DataFrame, ts: str, cells: Sequence[tuple[int, int, int]], by: Sequence[str] = (), key: str = "fold") -> DataFrame:
    """The test rows of every cell, with ``key`` and their ``lead``."""
    d = df.select("*", rows_left(ts, by).alias("__r"), series_length(by).alias("__n"))
    enough = _enough(cells, key)
    mine = F.filter(_cells(cells), lambda c: enough(c) & (F.col("__r") >= c["start"]) & (F.col("__r") < c["cut"]))
    d = d.where(F.col("__r") < max(b for *_, b in cells)).select("*", F.explode(mine).alias("__c"))
    return d.select(*df.columns, F.col("__c.cell").alias(key), (F.col("__c.cut") - F.col("__r")).cast("int").alias("lead"))


def backtest_baselines(df: DataFrame, names: Sequence[str], y: str, ts: str, cells: Sequence[tuple[int, int, int]], by: Sequence[str] = (),
                       key: str = "fold", season: int = 7) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores) of baselines on a daily table with every day, as :func:`backtest` gives them, from moments.

    History is reduced once per block between cuts; no train row is copied per cell.  Only the seasonal value is
    looked up, by date, for test rows.
    """
    if unknown := set(names) - {"last", "mean", "seasonal"}:
        raise ValueError(f"unknown baselines {sorted(unknown)}")
    keys = [*by, key]
    moments = train_moments(df, y, ts, cells, by, key)
    rows = test_rows(df.select(*by, ts, y), ts, cells, by, key)
    d = join_keys(rows, moments, keys, "inner", plain=[key])
    if "seasonal" in names:
        back = F.date_sub(F.col(ts).cast("date"), (F.ceil(F.col("lead") / F.lit(season)) * season).cast("int")).cast(df.schema[ts].dataType)
        old = df.select(*by, F.col(ts).alias("__src"), F.col(y).alias("seasonal"))
        d = join_keys(d.withColumn("__src", back), old, [*by, "__src"])
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("yhat")) for n in names])
    pred = d.select(*keys, "lead", ts, y, "naive_mae", "naive_rmse", F.inline(pairs))
    cols = score_columns(F.col(y), F.col("yhat"))
    g = pred.groupBy(*keys, "model").agg(*[c.alias(n) for n, c in cols.items()], F.max("naive_mae").alias("__a"), F.max("naive_rmse").alias("__b"))
    score = g.select(*keys, "model", "n", "mae", (F.col("mae") / F.col("__a")).alias("mase_lag1"), "rmse", (F.col("rmse") / F.col("__b")).alias("rmsse"),
                     "nmae", "nrmse", "mape", "smape", "r2")
    return pred.select(*keys, "model", "lead", ts, y, "yhat"), score


Model = Callable[[DataFrame, Sequence[str]], DataFrame]


def backtest(grid: DataFrame, models: Mapping[str, Model], y: str, ts: str, by: Sequence[str],
             extra: Sequence[str] = ("fold",)) -> DataFrame:
    """``(by, extra, model, lead, ts, y, yhat)`` on the test rows of every cell of the grid.

    A model is ``f(train, keys) -> (keys, lead, ts, yhat)``; folds and horizons are extra keys,
    so all cells of one model are one plan.
    """
    keys = [*by, *extra]
    train = grid.where("role = 'train'").drop("role")
    test = grid.where("role = 'test'").select(*keys, ts, y)
    out = union_all([f(train, keys).select(*keys, "lead", ts, "yhat", F.lit(name).alias("model"))
                     for name, f in models.items()])
    return test.join(out, [*keys, ts], "inner").select(*keys, "model", "lead", ts, y, "yhat")


def backtest_scores(grid: DataFrame, pred: DataFrame, y: str, ts: str, by: Sequence[str],
                    extra: Sequence[str] = ("fold",)) -> DataFrame:
    """Scores of every series, cell and model."""
    keys = [*by, *extra]
    return scores(pred, grid.where("role = 'train'"), y, "yhat", ts, keys, ["model"])


def rank_models(score: DataFrame, by: Sequence[str], metric: str = "smape") -> DataFrame:
    """Mean score over folds, lowest first; ranks per series."""
    m = score.groupBy(*by, "model").agg(F.avg(metric).alias("score"))
    return m.withColumn("rank", F.rank().over(series_window(by, F.col("score").asc_nulls_last())))


def ensemble_mean(pred: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Plain mean over the models."""
    return pred.groupBy(*by, ts).agg(F.avg("yhat").alias("yhat"))


def ensemble_weighted(pred: DataFrame, score: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Mean weighted by one over the score; models without a positive score are left out."""
    w = score.where("score > 0").select(*by, "model", (1 / F.col("score")).alias("__w"))
    d = join_keys(pred, w, [*by, "model"], "inner")
    return d.groupBy(*by, ts).agg((F.sum(F.col("__w") * F.col("yhat")) / F.sum("__w")).alias("yhat"))


def ensemble_best(pred: DataFrame, score: DataFrame, by: Sequence[str]) -> DataFrame:
    """The model with the lowest score of each series (the first by name on ties)."""
    best = score.where("score IS NOT NULL").groupBy(*by).agg(
        F.min(F.struct("score", "model"))["model"].alias("model"))
    return join_keys(pred, best, [*by, "model"], "inner")


def interval(forecast: DataFrame, residuals: DataFrame, by: Sequence[str], coverage: float = 0.9,
             y: str = "y", pool: int = 0) -> DataFrame:
    """Lower and upper bound from the backtest errors of the same lead and of leads at most ``pool`` away.

    A lead has one error per fold, too few for a bound of some percent.  An error ``d`` leads away counts
    ``pool + 1 - d`` times, so the nearest weigh most; a group holds (2 * pool + 1) errors per fold.
    """
    a = (1 - coverage) / 2
    near = F.sequence(F.col("lead") - pool, F.col("lead") + pool)
    e = residuals.select(*by, (F.col(y) - F.col("yhat")).alias("__e"), F.col("lead").alias("__l"), F.explode(near).alias("lead"))
    e = e.groupBy(*by, "lead").agg(F.percentile("__e", [a, 1 - a], pool + 1 - F.abs(F.col("lead") - F.col("__l"))).alias("__q"))
    d = join_keys(forecast, e, [*by, "lead"])
    return d.select(*forecast.columns, (F.col("yhat") + F.col("__q")[0]).alias("lower"),
                    (F.col("yhat") + F.col("__q")[1]).alias("upper"))


def with_fallback(primary: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row by row the first forecast that exists."""
    out = primary
    for i, o in enumerate(others):
        out = join_keys(out, o.select(*keys, F.col("yhat").alias(f"__o{i}")), list(keys))
    cols = [F.col("yhat"), *[F.col(f"__o{i}") for i in range(len(others))]]
    return out.select(*[F.coalesce(*cols).alias("yhat") if c == "yhat" else F.col(c) for c in primary.columns])


def prepare_regressors(reg: DataFrame, dates: DataFrame, ts: str, by: Sequence[str] = (),
                       target: str = "Wh") -> DataFrame:
    """Regressors on the target dates: target column dropped, empty ones dropped, gaps filled, then 0.

    The same step serves fit and forecast.
    """
    cols = [c for c in reg.columns if c not in (ts, target, *by)]
    num = reg.select(*by, ts, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    d = align(num, dates, [*by, ts])
    seen = d.agg(*[F.count(F.col(f"`{c}`")) for c in cols]).first() if cols else []
    cols = [c for c, n in zip(cols, seen) if n]
    d = fill(d.select(*dates.columns, *[F.col(f"`{c}`") for c in cols]), cols, ts, by, "ffill")
    return fill(d, cols, ts, by, "zero")


def forecast_in_chunks(history: DataFrame, model: Callable[[DataFrame, int], DataFrame], h: int,
                       step: int = 90, y: str = "y", ts: str = "ds", by: Sequence[str] = ()) -> DataFrame:
    """Forecast ``step`` days, append them to the history, fit again, until ``h`` days are done.

    ``model(history, n)`` returns ``(by, lead, ts, yhat)``.  Days it leaves out or has missing, as the
    models here do for a series that cannot be fitted, get the mean of the last 30 rows (or the last
    row).  Errors of the job itself are not held back.  The loop has ceil(h/step) turns; each chunk is
    written to the shared folder.
    """
    hist, parts, done = history.select(*by, ts, F.col(y).cast("double").alias(y)), [], 0
    while done < h:
        n = min(step, h - done)
        spine = future_spine(hist, ts, n, by)
        back = mean_or_last(hist, y, ts, by)
        chunk = _attach(join_keys(spine, model(hist, n).select(*by, ts, "yhat"), [*by, ts]), back, by)
        chunk = cut_lineage(chunk.select(*by, (F.col("lead") + done).alias("lead"), ts,
                                         F.coalesce("yhat", "fallback").alias("yhat")))
        parts.append(chunk)
        hist = union_all([hist, chunk.select(*by, ts, F.col("yhat").alias(y))])
        done += n
    return union_all(parts)
