"""Regressions per series, solved from sums that Spark adds up, and pooled tree models.

A series' normal equations are sums of products.  They are formed by one grouped aggregate
with map-side combination, so the length of a series never matters; what reaches Python is one
row of p*p numbers per series (and fold), as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal

from ..operators.ordered import join_keys, series_window
from ..session import cut_lineage
from .baselines import future_spine

# The solver below travels to the executors with the task, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PENALTIES = ("none", "ridge", "lasso", "elasticnet")


def datepart_features(ts: str, ks: Sequence[int] = (1, 2, 3)) -> dict[str, Column]:
    """Calendar columns of a daily series: trend, weekday flags and yearly harmonics."""
    d = F.col(ts)
    out = {"trend": F.unix_date(d.cast("date")).cast("double") / 365.25 - 30.0}
    out |= {f"dow_{i}": (F.weekday(d) == i).cast("double") for i in range(1, 7)}
    out |= cal.harmonics(d, ks, 365.25)
    return out


def lag_features(y: str, ts: str, by: Sequence[str], h: int, ns: Sequence[int] = (0, 1, 6, 7, 13, 27),
                 ws: Sequence[int] = (7, 28)) -> dict[str, Column]:
    """Lags and trailing means that are known ``h`` steps ahead, so scoring is one pass."""
    w = series_window(by, ts)
    out = {f"lag_{h + n}": F.lag(y, h + n).over(w) for n in ns}
    out |= {f"mean_{n}": F.avg(y).over(w.rowsBetween(-(h + n - 1), -h)) for n in ws}
    return out


def gram(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """``(by, __g)``: count, means and covariances for least squares, rows with a missing value left out.

    Covariances are the engine's own, which update running means; nothing is lost to large offsets.
    """
    whole = F.col(y).isNotNull()
    for x in xs:
        whole = whole & F.col(f"`{x}`").isNotNull()
    cols = [*[F.col(f"`{x}`").cast("double") for x in xs], F.col(y).cast("double")]
    p = len(cols)
    parts = [F.count(F.lit(1)).cast("double"), *[F.avg(c) for c in cols]]
    parts += [F.covar_pop(cols[i], cols[j]) for i in range(p) for j in range(i, p)]
    return df.where(whole).groupBy(*by).agg(F.array(*parts).alias("__g"))


def solve_moments(g: np.ndarray, penalty: str, alpha: float, l1_ratio: float = 0.5, sweeps: int = 10_000) -> np.ndarray:
    """Intercepts and coefficients, a row for each row of packed (count, means, upper covariances).

    Columns are scaled, so ``alpha`` means the same for each; columns that do not vary get 0.  Lasso
    and elastic net run coordinate descent on the correlations.  A row without data, or whose
    descent has not settled after ``sweeps`` rounds, is all NaN.
    """
    p = next(k for k in range(1, g.shape[1]) if 1 + k + k * (k + 1) // 2 == g.shape[1])
    mean, cov = g[:, 1:p + 1], np.zeros((len(g), p, p))
    i, j = np.triu_indices(p)
    cov[:, i, j] = cov[:, j, i] = g[:, p + 1:]
    sd = np.sqrt(np.clip(np.diagonal(cov, axis1=1, axis2=2)[:, :-1], 0.0, None))
    use = sd > 1e-9 * (1.0 + np.abs(mean[:, :-1]) * 1e-3)
    scale = np.where(use, 1.0 / np.where(use, sd, 1.0), 0.0)
    c = cov[:, :-1, :-1] * scale[:, :, None] * scale[:, None, :]
    r = cov[:, :-1, -1] * scale
    ok = np.isfinite(g).all(axis=1) & (g[:, 0] > 0)
    c, r = np.where(ok[:, None, None], c, 0.0), np.where(ok[:, None], r, 0.0)
    if penalty in ("none", "ridge"):
        lam = alpha if penalty == "ridge" else 0.0
        b = (np.linalg.pinv(c + lam * np.eye(p - 1), rcond=1e-10, hermitian=True) @ r[:, :, None])[:, :, 0]
    else:
        ratio = 1.0 if penalty == "lasso" else l1_ratio
        l1, l2 = alpha * ratio, alpha * (1.0 - ratio)
        b, moving = np.zeros_like(r), ok.copy()
        for _ in range(sweeps):
            old = b.copy()
            for k in range(p - 1):
                own = c[:, k, k]
                rho = r[:, k] - (c[:, k] * b).sum(axis=1) + own * b[:, k]
                step = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / np.where(own + l2 > 0, own + l2, 1.0)
                b[:, k] = np.where(moving, step, b[:, k])
            moving &= np.abs(b - old).max(axis=1, initial=0.0) >= 1e-10 * (1.0 + np.abs(b).max(axis=1, initial=0.0))
            if not moving.any():
                break
        ok &= ~moving
    beta = b * scale
    out = np.concatenate([(mean[:, -1] - (beta * mean[:, :-1]).sum(axis=1))[:, None], beta], axis=1)
    return np.where(ok[:, None], out, np.nan)


class LinearForecaster:
    """Least squares, ridge, lasso or elastic net, one model per series (and fold)."""

    def __init__(self, penalty: str = "none", alpha: float = 0.0, l1_ratio: float = 0.5, least: int | None = None):
        """``least``: rows a series needs; as many as coefficients without a penalty, else one, if not told."""
        if penalty not in PENALTIES:
            raise ValueError(f"unknown penalty {penalty!r}")
        self.penalty, self.alpha, self.l1_ratio, self.least = penalty, alpha, l1_ratio, least

    def fit(self, train: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
        """``(by, coef, status)``: intercept first; coefficients are missing where the status says that nothing could be fitted.

        ``no_rows``: no row with all values; ``too_short``: fewer rows than ``least``;
        ``not_settled``: the descent still moves; ``no_variation``: y is constant, which the coefficients repeat; else ``ok``.
        """
        g = gram(train, xs, y, by)
        p, pen, a, l1 = len(xs) + 1, self.penalty, self.alpha, self.l1_ratio
        least = self.least if self.least is not None else p if pen == "none" else 1
        size = 1 + p + p * (p + 1) // 2

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = np.array([[np.nan if x is None else x for x in v] for v in b.column("__g").to_pylist()], float).reshape(-1, size)
                found = solve_moments(packed, pen, a, l1)
                rows, still, lost = np.nan_to_num(packed[:, 0]), packed[:, -1] <= 1e-18 * (1.0 + packed[:, p] ** 2), np.isnan(found[:, 0])
                short = rows < least
                status = np.select([rows == 0, short, lost, still], ["no_rows", "too_short", "not_settled", "no_variation"], "ok").tolist()
                coef = [None if bad else v.tolist() for v, bad in zip(found, lost | short)]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in by], pa.array(coef, pa.list_(pa.float64())), pa.array(status)],
                                                 names=[*by, "coef", "status"])

        keys = ", ".join(f"`{c}` {g.schema[c].dataType.simpleString()}" for c in by)
        return g.mapInArrow(solve, (keys + ", " if keys else "") + "coef array<double>, status string")

    @staticmethod
    def predict(coef: DataFrame, future: DataFrame, xs: Sequence[str], by: Sequence[str],
                out: str = "yhat", status: str | None = None) -> DataFrame:
        """Intercept plus the weighted features; missing where a feature is.  ``status`` names a column for how the fit went."""
        if by:
            d = join_keys(future, coef.withColumnRenamed("status", "__status"), list(by))
        else:
            d = future.withColumn("coef", coef.select("coef").scalar()).withColumn("__status", coef.select("status").scalar())
        e = F.col("coef")[0]
        for i, x in enumerate(xs):
            e = e + F.col("coef")[i + 1] * F.col(f"`{x}`")
        told = [] if status is None else [F.coalesce("__status", F.lit("no_rows")).alias(status)]
        return d.select(*future.columns, e.alias(out), *told)


def forecast_every(history: DataFrame, h: int, y: str = "y", ts: str = "ds", by: Sequence[str] = ("variable",),
                   model: LinearForecaster | None = None, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``(by, lead, ts, yhat, status)``: the date-part regression of every variable of a long table, ``h`` days ahead, in one job.

    A variable that cannot be fitted has rows without a forecast and a status that says why; the others go on.
    """
    model = model or LinearForecaster()
    xs = datepart_features(ts, ks)
    add = [c.alias(n) for n, c in xs.items()]
    coef = model.fit(history.select(*by, y, *add), list(xs), y, by)
    future = future_spine(history, ts, h, by)
    return model.predict(coef, future.select("*", *add), list(xs), by, status="status").select(*future.columns, "yhat", "status")


def fit_predict_datepart(train: DataFrame, future: DataFrame, y: str, ts: str, by: Sequence[str],
                         model: LinearForecaster | None = None, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Date-part regression: calendar and harmonics to y."""
    model = model or LinearForecaster()
    xs = datepart_features(ts, ks)
    add = [c.alias(n) for n, c in xs.items()]
    coef = model.fit(train.select(*by, y, *add), list(xs), y, by)
    return model.predict(coef, future.select("*", *add), list(xs), by).select(*future.columns, "yhat")


def fit_predict_window(full: DataFrame, is_train: Column, y: str, ts: str, by: Sequence[str], h: int,
                       model: LinearForecaster | None = None, is_target: Column | None = None) -> DataFrame:
    """Lagged-window regression in direct form.

    ``full`` is the complete series including the rows to be forecast; only values at least
    ``h`` steps old enter a feature.
    """
    model = model or LinearForecaster("ridge", 1e-3)
    xs = lag_features(y, ts, by, h)
    d = full.select("*", *[c.alias(n) for n, c in xs.items()], is_train.alias("__train"))
    coef = model.fit(d.where("__train"), list(xs), y, by)
    rest = d.where(~F.col("__train")) if is_target is None else d.where(is_target)
    return model.predict(coef, rest, list(xs), by).select(*full.columns, "yhat")


class TreeForecaster:
    """Random forest or gradient-boosted trees over all series together.

    A series enters through the level and spread of its own train values, beside the calendar
    and lag columns.  Unlike an index feature that needs no list of series on the driver, and
    one distributed fit serves any number of them.
    """

    def __init__(self, kind: str = "rf", seed: int = 7, **params):
        self.kind, self.seed, self.params = kind, seed, params

    def _with_level(self, df: DataFrame) -> DataFrame:
        return join_keys(df, self.level, self.by) if self.by else df

    def fit(self, train: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
        self.by = list(by)
        level = ["__level", "__spread"] if by else []
        self.level = train.groupBy(*by).agg(F.avg(y).alias("__level"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("__spread"))
        cls = {"rf": RandomForestRegressor, "gbt": GBTRegressor}[self.kind]
        stages = [VectorAssembler(inputCols=[*level, *xs], outputCol="__x"),
                  cls(featuresCol="__x", labelCol=y, predictionCol="yhat", seed=self.seed, **self.params)]
        # growing trees goes over the table many times; the rows behind it are read once
        self.inputs = [*level, *xs]
        table = cut_lineage(self._with_level(train.where(F.col(y).isNotNull())).dropna(subset=self.inputs))
        self.model = Pipeline(stages=stages).fit(table)
        return self

    def predict(self, future: DataFrame) -> DataFrame:
        """One row for each; ``yhat`` is missing where a feature is."""
        d = self._with_level(future)
        whole = F.lit(True)
        for c in self.inputs:
            whole = whole & F.col(f"`{c}`").isNotNull()
        keep = {c: f"__k{i}" for i, c in enumerate(future.columns) if c in self.inputs}
        kept = d.withColumns({k: F.col(f"`{c}`") for c, k in keep.items()}).withColumn("__whole", whole)
        filled = kept.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.inputs})
        out = self.model.transform(filled)
        return out.select(*[F.col(keep.get(c, f"`{c}`")).alias(c) for c in future.columns],
                          F.when(F.col("__whole"), F.col("yhat").cast("double")).alias("yhat"))
