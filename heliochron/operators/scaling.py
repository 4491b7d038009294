"""Range mapping, min-max scaling by a reference, year projection and series transforms."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import to_number
from .ordered import join_keys, series_window
from .quantile import exact_percentiles


def _range(df: DataFrame, col: str, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias(f"__{name}_min"), F.max(col).alias(f"__{name}_max"))


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics beside each row: by key, or as scalar subqueries where there is one row."""
    if by:
        return join_keys(df, stats, list(by))
    return df.select("*", *[stats.select(c).scalar().alias(c) for c in stats.columns])


def _span(lo: Column, hi: Column, what: str) -> Column:
    return F.when(hi == lo, F.raise_error(F.lit(f"{what} has a range of zero")).cast("double")).otherwise(hi - lo)


def map_range(df: DataFrame, col: str, ref: DataFrame, ref_col: str, by: Sequence[str] = (),
              mapped: str | None = None, normalised: str | None = None) -> DataFrame:
    """Map ``col`` from its own range to the reference's, and to 0-1 of the reference's range.

    A range of zero on either side is an error.
    """
    mapped, normalised = mapped or f"{col}_mapped", normalised or f"{col}_normalised"
    d = _attach(_attach(df, _range(df, col, by, "own"), by), _range(ref, ref_col, by, "ref"), by)
    v, lo, hi = F.col(col), F.col("__ref_min"), F.col("__ref_max")
    own = _span(F.col("__own_min"), F.col("__own_max"), col)
    wide = _span(lo, hi, ref_col)
    return d.select(*df.columns, ((v - F.col("__own_min")) / own * (hi - lo) + lo).alias(mapped),
                    ((v - lo) / wide).alias(normalised))


def normalise_by_ref(df: DataFrame, col: str, ref: DataFrame, ref_col: str, by: Sequence[str] = (),
                     out: str | None = None) -> DataFrame:
    """``(v - ref_min) / (ref_max - ref_min)``."""
    out = out or f"{col}_normalised"
    d = _attach(df, _range(ref, ref_col, by, "ref"), by)
    lo, hi = F.col("__ref_min"), F.col("__ref_max")
    return d.select(*df.columns, ((F.col(col) - lo) / _span(lo, hi, ref_col)).alias(out))


def ref_stats(ref: DataFrame, ref_col: str = "Wh", by: Sequence[str] = (), unit: str = "auto") -> DataFrame:
    """Unit, range in Wh and kWh, and count of a reference column.

    ``auto`` takes a median of 1000 or more for Wh, anything lower for kWh.
    """
    d = ref.select(*by, to_number(F.col(ref_col)).alias("__v")).where("__v IS NOT NULL")
    s = d.groupBy(*by).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("__v").alias("count"))
    if unit == "auto":
        med = exact_percentiles(d, ["__v"], [0.5], by).select(*by, F.col("value").alias("med"))
        s = join_keys(s, med, list(by)) if by else s.withColumn("med", med.select("med").scalar())
        found = F.when(F.col("med") >= 1000, "wh").otherwise("kwh")
    else:
        found = F.lit(unit)
    k = F.when(found == "kwh", 1000.0).otherwise(1.0)
    return s.select(*by, found.alias("unit_detected"), (F.col("lo") * k).alias("min_wh"),
                    (F.col("hi") * k).alias("max_wh"), (F.col("lo") * k / 1000).alias("min_kwh"),
                    (F.col("hi") * k / 1000).alias("max_kwh"), "count")


def stats_to_json(stats: DataFrame) -> str:
    """The one row of :func:`ref_stats` as JSON text."""
    return json.dumps(stats.first().asDict(), indent=2)


def stats_from_json(spark, text: str) -> DataFrame:
    return spark.createDataFrame([json.loads(text)], "unit_detected string, min_wh double, max_wh double, "
                                 "min_kwh double, max_kwh double, count bigint")


# Columns of a day block that are scaled along with its energy.
P_SISTERS = ("P_kWh", "P_mean", "P_min", "P_max", "P_std", "P_p10", "P_p90")


def minmax_by_ref(df: DataFrame, cols: Sequence[str], stats: DataFrame, by: Sequence[str] = (),
                  clip: bool = False, n_obs: str = "n_obs_P", wh_cols: Sequence[str] = ("P_Wh",),
                  suffix: str = "_minmax_by_solar") -> DataFrame:
    """Scale columns to 0-1 of the reference's range after conversion to Wh.

    A kWh name is multiplied by 1000; the Wh columns are taken as they are; the rest is power
    and is multiplied by the day's observation count (24 where there is no such column).  With
    a range of zero only the minimum is taken off.  ``P_Wh`` brings along those of ``P_SISTERS`` there are.
    """
    cols = [*cols, *[c for c in P_SISTERS if "P_Wh" in cols and c not in cols]]
    d = _attach(df, stats.select(*by, "min_wh", "max_wh"), by)
    lo, hi = F.col("min_wh"), F.col("max_wh")
    hours = F.coalesce(F.col(n_obs).cast("double"), F.lit(0.0)) if n_obs in df.columns else F.lit(24.0)
    out = []
    for c in (c for c in cols if c in df.columns):
        v = to_number(F.col(f"`{c}`"))
        wh = v * 1000.0 if "kwh" in c.lower() else v if c in wh_cols else v * hours
        s = F.when(hi == lo, wh - lo).otherwise(F.try_divide(wh - lo, hi - lo))
        if clip:
            s = F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
        out.append(s.alias(c + suffix))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *out)


def project_year(df: DataFrame, ts: str, years: Column, tz: str = "Asia/Taipei", out: str = "local_time") -> DataFrame:
    """Typical-year UTC times set to the smallest source year, then shown as local time.

    ``years`` maps month to source year.  Taking each month to its source year and then all of
    them to one year keeps month, day and clock, so only the target year matters for the
    result; a 29 February that the target year lacks is dropped.  The shift to local time
    carries the year's last hours into a further day.
    """
    t = F.col(ts)
    target = F.array_min(F.map_values(years))
    year = F.coalesce(target, F.year(t))
    txt = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.date_format(t, "MM-dd HH:mm:ss"))
    utc = txt.try_cast("timestamp_ntz")
    d = df.select("*", F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).alias(out))
    return d.where(F.col(out).isNotNull())


def clip_zero(c: Column) -> Column:
    """No negative forecasts; a missing one stays missing."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


TRANSFORMS = ("difference", "zscore", "minmax", "detrend", "clip_outliers", "seasonal_difference")


def series_stats(df: DataFrame, y: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-series numbers that the scaling transforms and their inverses need."""
    t = _position(ts)
    return df.groupBy(*by).agg(
        F.avg(y).alias("__mean"), F.stddev_samp(y).alias("__sd"), F.min(y).alias("__min"), F.max(y).alias("__max"),
        F.regr_slope(F.col(y), t).alias("__slope"), F.regr_intercept(F.col(y), t).alias("__icpt"))


def _position(ts: str) -> Column:
    """Days since 1970 as a number."""
    return F.unix_date(F.col(ts).cast("date")).cast("double")


def transform(df: DataFrame, name: str, y: str, ts: str, by: Sequence[str] = (), out: str | None = None,
              m: int = 7) -> DataFrame:
    """One of ``TRANSFORMS`` on a daily series."""
    return transforms(df, {name: out or f"{y}_{name}"}, y, ts, by, m)


def transforms(df: DataFrame, names: dict[str, str], y: str, ts: str, by: Sequence[str] = (),
               m: int = 7) -> DataFrame:
    """Several transforms at once (name to output column): one join of the series' numbers."""
    v, w = F.col(y), series_window(by, ts)
    lagged = {"difference": 1, "seasonal_difference": m}
    d = df
    if set(names) - set(lagged):
        d = _attach(df, series_stats(df, y, ts, by), by)
    mean, sd = F.col("__mean"), F.col("__sd")
    e = {n: v - F.lag(v, k).over(w) for n, k in lagged.items()} | {
        "zscore": F.try_divide(v - mean, sd),
        "minmax": F.try_divide(v - F.col("__min"), F.col("__max") - F.col("__min")),
        "detrend": v - (F.col("__icpt") + F.col("__slope") * _position(ts)),
        "clip_outliers": F.when(v > mean + 3 * sd, mean + 3 * sd).when(v < mean - 3 * sd, mean - 3 * sd).otherwise(v),
    }
    return d.select(*df.columns, *[e[n].alias(out) for n, out in names.items()])


def inverse(df: DataFrame, name: str, z: str, stats: DataFrame, ts: str, by: Sequence[str] = (),
            out: str = "y", first: str | None = None, m: int = 7) -> DataFrame:
    """Undo a transform.

    ``stats`` is :func:`series_stats` of the untransformed series.  The two differences need
    ``first``: a column that holds the original value where the difference has none.  Clipping
    cannot be undone and returns its input.
    """
    v = F.col(z)
    if name in ("difference", "seasonal_difference"):
        step = 1 if name == "difference" else m
        pos = F.row_number().over(series_window(by, ts)) - 1
        d = df.withColumn("__lane", F.pmod(pos, F.lit(step)))
        run = series_window([*by, "__lane"], ts).rowsBetween(Window.unboundedPreceding, 0)
        return d.select(*df.columns, F.sum(F.coalesce(v, F.col(first))).over(run).alias(out))
    d = _attach(df, stats, by)
    e = {
        "zscore": v * F.col("__sd") + F.col("__mean"),
        "minmax": v * (F.col("__max") - F.col("__min")) + F.col("__min"),
        "detrend": v + F.col("__icpt") + F.col("__slope") * _position(ts),
        "clip_outliers": v,
    }[name]
    return d.select(*df.columns, e.alias(out))
