"""Joins and alignment of daily and hourly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import union_all
from .features import fill
from .ordered import join_keys


def left_join_days(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                   by: Sequence[str] = (), suffix: str = "_ext") -> DataFrame:
    """Left join by day; clashing right names get the suffix and the right key goes."""
    ren = {c: (left_on if c == right_on else c + suffix if c in left.columns and c not in by else c)
           for c in right.columns}
    return join_keys(left, right.select(*[F.col(f"`{c}`").alias(n) for c, n in ren.items()]),
                     [*by, left_on])


def merge_by_date(a: DataFrame, b: DataFrame, how: str = "outer", on: str = "Date",
                  suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Join on the date text with suffixed clashes; missing dates match each other."""
    clash = (set(a.columns) & set(b.columns)) - {on}
    name = lambda c, s: c + s if c in clash else c
    x = a.select(*[F.col(f"`{c}`").alias("__ka" if c == on else name(c, suffixes[0])) for c in a.columns])
    y = b.select(*[F.col(f"`{c}`").alias("__kb" if c == on else name(c, suffixes[1])) for c in b.columns])
    j = x.join(y, x["__ka"].eqNullSafe(y["__kb"]), how)
    return j.select(F.coalesce("__ka", "__kb").alias(on),
                    *[F.col(f"`{c}`") for c in j.columns if c not in ("__ka", "__kb")])


def coalesce_pairs(df: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Each ``x_a``/``x_b`` pair as one ``x``, history before forecast."""
    a, b = suffixes
    bases = sorted(c[: -len(a)] for c in df.columns
                   if c.endswith(a) and c[: -len(a)] + b in df.columns)
    gone = {x + s for x in bases for s in suffixes}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in gone and c not in bases]
    return df.select(*rest, *[F.coalesce(f"`{x}{a}`", f"`{x}{b}`").alias(x) for x in bases])


def dates_first(df: DataFrame, date: str = "Date", local: str = "LocalTime") -> DataFrame:
    """Date, then LocalTime (from Date where missing), then the rest."""
    txt = F.date_format(F.col(date).cast("date"), "yyyy-MM-dd")
    loc = F.coalesce(F.col(local).cast("string"), txt) if local in df.columns else txt
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (date, local)]
    return df.select(date, loc.alias(local), *rest)


def merge_forecasts(long: DataFrame, ds: str, variable: str, y: str,
                    variables: Sequence[str] | None = None) -> DataFrame:
    """One column per variable on the union of dates: one pivot instead of N joins."""
    return long.groupBy(ds).pivot(variable, list(variables) if variables else None).agg(F.first(y, True))


def align(df: DataFrame, dates: DataFrame, on: Sequence[str]) -> DataFrame:
    """The table's rows at the target dates; dates without one have missing values."""
    return join_keys(dates, df, list(on))


def align_month_day(series: DataFrame, dates: DataFrame, ds: str, value: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact date first, else the mean of that month-day over all years.

    The month-day map has at most 366 rows per series; without series keys that bound makes a
    broadcast safe.
    """
    md = F.date_format(F.col(ds), "MM-dd").alias("__md")
    means = series.groupBy(*by, md).agg(F.avg(value).alias("__mean"))
    exact = join_keys(dates, series.select(*by, ds, F.col(value).alias("__exact")), [*by, ds])
    if not by:
        means = F.broadcast(means)
    j = join_keys(exact.withColumn("__md", md), means, [*by, "__md"])
    return j.select(*dates.columns, F.coalesce("__exact", "__mean").alias(value))


def typical_name(col: str) -> str:
    """``tmy_`` name of a measure: unit brackets removed."""
    # What goes from a name, in this order.
    for bit, to in (("(h)", ""), ("(n)", ""), ("(", ""), (")", ""), (" ", ""), ("/", "_")):
        col = col.replace(bit, to)
    return f"tmy_{col}"


def align_typical_year(target: DataFrame, typical: DataFrame, ts: str, typical_ts: str,
                       cols: Sequence[str], tz: str = "Asia/Taipei", by: Sequence[str] = ()) -> DataFrame:
    """Project a typical year (UTC) onto local target hours by month, day and hour.

    29 February falls back on the 28th.  The year has at most 8,784 keys per series.
    """
    key = lambda c: F.date_format(c, "MM-dd-HH")
    means = typical.groupBy(*by, key(F.col(typical_ts)).alias("__key")).agg(
        *[F.avg(F.col(f"`{c}`")).alias(typical_name(c)) for c in cols])
    # leap-day rows the typical year lacks are added from the 28th, so one join is enough
    names = [typical_name(c) for c in cols]
    leap = means.where(F.col("__key").startswith("02-28-")).select(
        *by, F.regexp_replace("__key", "^02-28", "02-29").alias("__key"), F.lit(1).alias("__pri"), *names)
    both = union_all([means.select(*by, "__key", F.lit(0).alias("__pri"), *names), leap])
    year = both.groupBy(*by, "__key").agg(F.min_by(F.struct(*names), "__pri").alias("__v")).select(
        *by, "__key", "__v.*")
    if not by:
        year = F.broadcast(year)
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(ts))
    return join_keys(target.withColumn("__key", key(utc)), year, [*by, "__key"]).drop("__key")


def align_fill(df: DataFrame, dates: DataFrame, ds: str, cols: Sequence[str],
               by: Sequence[str] = ()) -> DataFrame:
    """Exact dates, then forward and backward fill over the target dates."""
    j = align(df.select(*by, ds, *cols), dates, [*by, ds])
    return fill(j, cols, ds, by, "ffill")


def merge_regressors(dates: DataFrame, tables: Sequence[DataFrame], ds: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Regressor tables side by side on the target dates, filled; on a clash the left wins."""
    out, seen = dates, set(dates.columns)
    for t in tables:
        new = [c for c in t.columns if c not in seen]
        out = join_keys(out, t.select(*by, ds, *[F.col(f"`{c}`") for c in new]), [*by, ds])
        seen |= set(new)
    cols = [c for c in out.columns if c not in dates.columns]
    num = [F.col(f"`{c}`").try_cast("double").alias(c) if c in cols else F.col(f"`{c}`") for c in out.columns]
    return fill(out.select(*num), cols, ds, by, "ffill")


def common_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Regressors that history and future share, sorted."""
    return sorted((set(a.columns) & set(b.columns)) - set(exclude))


def overlap(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sides at the keys they share."""
    return a.join(b, list(on), "inner")
