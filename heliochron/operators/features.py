"""Fills, lags, rolling windows, calendar columns, naive baselines, split and weights.

These work on calendar tables (one row per series and step, see ``ordered``).  ``width``
makes lags and rolling windows run in chunks of that many steps for very long grids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.times import MICROS
from .ordered import CHUNK, chunk_by_time, fill_by_chunk, join_keys, series_window, with_halo


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection that replaces or appends columns."""
    old = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return df.select(*old, *[v.alias(k) for k, v in new.items() if k not in df.columns])


def fill(df: DataFrame, cols: Sequence[str], ts: str, by: Sequence[str] = (), method: str = "ffill",
         both: bool = True, step: str = "day", width: int | None = None) -> DataFrame:
    """Forward fill then backward (``ffill``), the other way round (``bfill``), or zeros.

    ``both=False`` keeps to the first direction, so nothing leaks from the future.  With ``width`` the
    fill runs in chunks of so many steps, each handing its last known values on.
    """
    if method == "zero":
        return _replace(df, {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cols})
    if width is not None:
        out, chunk = df, chunk_by_time(ts, width * MICROS[step] // 1_000_000)
        for forward in ((True, False) if method == "ffill" else (False, True))[:1 + both]:
            out = fill_by_chunk(out, cols, ts, chunk, by, forward)
        return out
    w = series_window(by, ts)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ways = [lambda c: F.last(c, True).over(past), lambda c: F.first(c, True).over(ahead)]
    if method == "bfill":
        ways.reverse()
    ways = ways if both else ways[:1]
    return _replace(df, {c: F.coalesce(*[f(F.col(f"`{c}`")) for f in ways]) for c in cols})


def _windowed(df: DataFrame, ts: str, by: Sequence[str], new, reach: int, step: str, width: int | None):
    if width is None:
        return _replace(df, new(series_window(by, ts)))
    d = with_halo(df, ts, step, max(width, reach), reach)
    return _replace(d, new(Window.partitionBy(*by, CHUNK).orderBy(ts))).where(~F.col("__halo")).drop(CHUNK, "__halo")


def lags(df: DataFrame, col: str, ts: str, ns: Sequence[int] = (1, 7, 14, 30), by: Sequence[str] = (),
         step: str = "day", width: int | None = None) -> DataFrame:
    """``<col>_lag<n>`` for each n."""
    new = lambda w: {f"{col}_lag{n}": F.lag(F.col(f"`{col}`"), n).over(w) for n in ns}
    return _windowed(df, ts, by, new, max(ns), step, width)


def rolling(df: DataFrame, col: str, ts: str, ws: Sequence[int] = (7, 14, 30), by: Sequence[str] = (),
            step: str = "day", width: int | None = None) -> DataFrame:
    """Mean and sample deviation of the ``w`` rows before; a missing deviation is 0."""
    def new(w):
        out = {}
        for n in ws:
            span = w.rowsBetween(-n, -1)
            out[f"{col}_roll_mean_{n}"] = F.avg(F.col(f"`{col}`")).over(span)
            out[f"{col}_roll_std_{n}"] = F.coalesce(F.stddev_samp(F.col(f"`{col}`")).over(span), F.lit(0.0))
        return out
    return _windowed(df, ts, by, new, max(ws), step, width)


def rolling_means(df: DataFrame, cols: Sequence[str], ts: str, n: int = 7, by: Sequence[str] = (),
                  step: str = "day", width: int | None = None) -> DataFrame:
    """``<col>_roll<n>``: mean of the n rows before, for many columns on one sort."""
    new = lambda w: {f"{c}_roll{n}": F.avg(F.col(f"`{c}`")).over(w.rowsBetween(-n, -1)) for c in cols}
    return _windowed(df, ts, by, new, n, step, width)


def add_calendar(df: DataFrame, ts: str) -> DataFrame:
    return _replace(df, cal.calendar(F.col(ts)))


def add_harmonics(df: DataFrame, ts: str, ks: Sequence[int] = (1, 2, 3), year_days: float = 365.0) -> DataFrame:
    return _replace(df, cal.harmonics(F.col(ts), ks, year_days))


def add_dummies(df: DataFrame, ts: str) -> DataFrame:
    return _replace(df, cal.dummies(F.col(ts)))


def model_features(df: DataFrame, target: str, regressors: Sequence[str], ts: str, by: Sequence[str] = (),
                   ns: Sequence[int] = (1, 7, 14, 30), ws: Sequence[int] = (7, 14, 30),
                   lag365: bool = False) -> DataFrame:
    """The whole feature block of a daily series: fills, lags, rolling windows and calendar."""
    d = fill(df, [target, *regressors], ts, by)
    d = lags(d, target, ts, [*ns, 365] if lag365 else ns, by)
    d = rolling(d, target, ts, ws, by)
    if regressors:
        d = rolling_means(d, regressors, ts, 7, by)
    return add_calendar(d, ts)


def series_length(by: Sequence[str] = ()) -> Column:
    """Rows of the series, on each of them."""
    return F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(0)])))


def rows_left(ts: str, by: Sequence[str] = ()) -> Column:
    """Rows after this one; in time order, so that lags and this share one sort."""
    return series_length(by) - F.row_number().over(series_window(by, ts))


def mark_holdout(df: DataFrame, ts: str, h: int, by: Sequence[str] = (), out: str = "is_test") -> DataFrame:
    """Flag the last ``h`` rows of each series; series of ``h`` rows or fewer are left out."""
    left = rows_left(ts, by)
    length = series_length(by)
    return (df.select("*", left.alias("__left"), length.alias("__len")).where(F.col("__len") > h)
            .select(*df.columns, (F.col("__left") < h).alias(out)))


def holdout(df: DataFrame, ts: str, h: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    m = mark_holdout(df, ts, h, by)
    return m.where(~F.col("is_test")).drop("is_test"), m.where("is_test").drop("is_test")


def naive_lag(df: DataFrame, y: str, ts: str, n: int = 1, by: Sequence[str] = (), out: str = "yhat") -> DataFrame:
    """The value ``n`` rows before; apply before the test rows are split off."""
    return _replace(df, {out: F.lag(y, n).over(series_window(by, ts))})


def naive_carry(df: DataFrame, y: str, ts: str, by: Sequence[str] = (), out: str = "yhat") -> DataFrame:
    """The last known value before each row, carried over rows without one."""
    w = series_window(by, ts).rowsBetween(Window.unboundedPreceding, -1)
    return _replace(df, {out: F.last(y, True).over(w)})


def naive_mean(train: DataFrame, test: DataFrame, y: str, by: Sequence[str] = (), out: str = "yhat") -> DataFrame:
    """The train mean on every test row."""
    m = train.groupBy(*by).agg(F.avg(y).alias(out))
    return join_keys(test, m, list(by)) if by else test.withColumn(out, m.scalar())


def fill_trailing_mean(df: DataFrame, y: str, ts: str, by: Sequence[str] = (), n: int = 30,
                       out: str | None = None, only: Column | None = None) -> DataFrame:
    """Each missing value is the mean of the last ``n`` known or filled ones; with fewer than
    ``n`` the last one; with none 0.

    A value depends on values filled before it, so each series is one fold over its days;
    series run side by side.  With ``only`` just the rows that meet it are filled; other
    missing rows are passed over.
    """
    out = out or y
    may = F.lit(True) if only is None else only
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).cast("double").alias("y"),
                                                may.alias("m"))))
    g = df.groupBy(*by).agg(rows.alias("__rows"))

    def step(acc, x):
        last = acc["last"]
        mean = F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / F.lit(float(n))
        guess = (F.when(F.size(last) >= n, mean)
                 .when(F.size(last) >= 1, F.try_element_at(last, F.lit(-1))).otherwise(F.lit(0.0)))
        gap = x["y"].isNull() & x["m"]
        v = F.when(gap, guess).otherwise(x["y"])
        grown = F.when(v.isNull(), last).otherwise(
            F.slice(F.concat(last, F.array(v)), F.greatest(F.size(last) + 2 - n, F.lit(1)), F.lit(n)))
        one = F.array(F.struct(x["t"].alias("t"), v.alias("v")))
        full = gap & (F.size(acc["filled"]) >= part)
        filled = F.when(full, one).when(gap, F.concat(acc["filled"], one)).otherwise(acc["filled"])
        done = F.when(full, F.concat(acc["done"], F.array(acc["filled"]))).otherwise(acc["done"])
        return F.struct(grown.alias("last"), filled.alias("filled"), done.alias("done"))

    part = 128  # filled values kept in one array; adding one copies no more than that, however many there are
    kind = f"array<struct<t:{df.schema[ts].dataType.simpleString()},v:double>>"
    zero = F.struct(F.array().cast("array<double>").alias("last"), F.array().cast(kind).alias("filled"), F.array().cast(f"array<{kind}>").alias("done"))
    made = F.aggregate("__rows", zero, step, lambda acc: F.concat(acc["done"], F.array(acc["filled"])))
    z = g.select(*by, F.explode(made).alias("__p")).select(*by, F.inline("__p").alias(ts, "__v"))
    return _replace(join_keys(df, z, [*by, ts]), {out: F.coalesce(F.col(y).cast("double"), "__v")}).drop("__v")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs; 0 where either side does not vary."""
    px, py = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.coalesce(F.when(varies & ~F.isnan(r), r), F.lit(0.0))


def feature_weights(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = (),
                    top_n: int | None = None) -> DataFrame:
    """Share of each feature in the summed absolute correlations with the target."""
    row = df.groupBy(*by).agg(*[safe_corr(F.col(f"`{c}`"), F.col(f"`{target}`")).alias(f"__c{i}")
                                for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__c{i}").alias("corr"))
                      for i, c in enumerate(features)])
    d = row.select(*by, F.inline(pairs)).withColumn("abs_corr", F.abs("corr"))
    total = F.sum("abs_corr").over(Window.partitionBy(*(by or [F.lit(0)])))
    d = d.withColumn("weight", F.when(total > 0, F.col("abs_corr") / total).otherwise(F.lit(0.0)))
    if top_n is not None:
        best = series_window(by, F.col("weight").desc(), "column")
        d = d.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top_n).drop("__r")
    return d


def unpivot_series(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable",
                   y: str = "y") -> DataFrame:
    """Wide to long, each variable without its missing rows."""
    wide = df.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values])
    return wide.unpivot(list(ids), list(values), variable, y).where(F.col(y).isNotNull())
