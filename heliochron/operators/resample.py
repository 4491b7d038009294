"""Resampling, gap filling, daily blocks and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.circular import directions_from_sums, sector_index, sector_name, sector_sums
from ..functions.times import floor_time, micros, step_interval
from ..session import cut_lineage, union_all
from .ordered import CHUNK, chunk_by_number, join_keys, series_window
from .quantile import is_large, percentiles_of_columns, percentiles_of_counts, small_percentile

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp,
              "count": F.count}


def complete(df: DataFrame, ts: str, step: str, by: Sequence[str] = ()) -> DataFrame:
    """Every step between the first and last row of a series; new rows hold no values.

    Takes a table with one row per series and step and opens each gap in place, so the raw
    table behind it is read once and no spine has to be joined.
    """
    w = series_window(by, ts)
    nxt = F.lead(ts).over(w)
    d = df.withColumn("__next", nxt)
    until = F.col("__next") - step_interval(step)
    if df.schema[ts].dataType.typeName() == "date":
        until = until.cast("date")
    steps = F.when(F.col("__next").isNull(), F.array(F.col(ts))).otherwise(
        F.sequence(F.col(ts), until, step_interval(step)))
    d = d.select("*", F.posexplode(steps).alias("__i", "__at"))
    first = F.col("__i") == 0
    return d.select(*[F.col("__at").alias(c) if c == ts else F.col(f"`{c}`") if c in by
                      else F.when(first, F.col(f"`{c}`")).alias(c) for c in df.columns])


def spine_between(bounds: DataFrame, start: str, end: str, step: str, out: str = "ds") -> DataFrame:
    """All steps from ``start`` to ``end`` of each row (both included)."""
    keep = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*keep, F.explode(F.sequence(F.col(start), F.col(end), step_interval(step))).alias(out))


def resample(df: DataFrame, ts: str, step: str, aggs: Mapping[str, str], by: Sequence[str] = (),
             full: bool = True) -> DataFrame:
    """One row per series and step; with ``full`` also the steps without rows, where a sum or
    count is 0 and anything else is missing.  Rows without a time are left out; times far off
    should be repaired first, as ``full`` opens the gap to them."""
    g = df.where(F.col(ts).isNotNull()).groupBy(*by, floor_time(F.col(ts), step).alias(ts)).agg(
        *[AGGREGATES[f](F.col(f"`{c}`")).alias(c) for c, f in aggs.items()])
    if full:
        g = complete(g, ts, step, by)
    zero = {c for c, f in aggs.items() if f in ("sum", "count")}
    return g.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in zero else F.col(f"`{c}`")
                      for c in g.columns])


def fill_hour_of_day(df: DataFrame, ts: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing hours take the mean of that clock hour over all days."""
    w = Window.partitionBy(*by, F.hour(ts))
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.avg(F.col(f"`{c}`")).over(w)).alias(c)
                       if c in cols else F.col(f"`{c}`") for c in df.columns])


def group_mean(df: DataFrame, col: str, keys: Sequence, out: str) -> DataFrame:
    """The mean of each group on all its rows; for calendar tables, whose groups are bounded."""
    w = Window.partitionBy(*keys)
    return df.select("*", F.avg(F.col(f"`{col}`")).over(w).alias(out))


def daily_energy(df: DataFrame, ts: str, sum_cols: Sequence[str], mean_cols: Sequence[str] = (),
                 by: Sequence[str] = ()) -> DataFrame:
    """Days that occur: energy summed, other measures averaged."""
    return resample(df, ts, "day", {**{c: "sum" for c in sum_cols}, **{c: "mean" for c in mean_cols}},
                    by, full=False)


def monthly_energy(df: DataFrame, ts: str, value: str, by: Sequence[str] = (),
                   out: str | None = None) -> DataFrame:
    """Month sums under a ``YYYY-MM`` key; months without rows are 0."""
    m = resample(df, ts, "month", {value: "sum"}, by)
    return m.select(*by, F.date_format(ts, "yyyy-MM").alias("month"),
                    F.col(value).alias(out or f"{value}_sum"))


def _times(df: DataFrame, ts: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).select(*by, micros(F.col(ts)).alias("__us"))


def chunk_ends(df: DataFrame, ts: str, by: Sequence[str] = (), chunk_seconds: int = 21_600) -> DataFrame:
    """First and last time (in microseconds) of each series and chunk."""
    chunk = chunk_by_number("__us", chunk_seconds * 1_000_000).alias(CHUNK)
    return _times(df, ts, by).groupBy(*by, chunk).agg(F.min("__us").alias("__lo"), F.max("__us").alias("__hi"))


def step_counts(df: DataFrame, ts: str, by: Sequence[str] = (), chunk_seconds: int = 21_600) -> DataFrame:
    """``(by, variable, value, freq)``: distances of successive times in seconds and how often each occurs.

    Equal times are counted first (each further copy is a distance of 0), so neither a hot
    series nor a hot instant is ordered as a whole.  Distances inside a chunk come from its
    own rows, those across chunks from one (first, last) row per chunk; nothing is joined
    back.  A series' first time has no distance and stays as one missing value, which counts 0 times.
    """
    t = _times(df, ts, by)
    chunk = chunk_by_number("__us", chunk_seconds * 1_000_000).alias(CHUNK)
    one = t.groupBy(*by, "__us").agg(F.count(F.lit(1)).alias("__c")).withColumn(CHUNK, chunk)
    inside = Window.partitionBy(*by, CHUNK).orderBy("__us")
    seconds = lambda us: (us / F.lit(1_000_000)).cast("double")
    once = F.lit(1).cast("bigint")
    parts = F.array(F.struct(seconds(F.col("__us") - F.lag("__us").over(inside)).alias("value"), once.alias("freq")),
                    F.struct(F.lit(0.0).alias("value"), (F.col("__c") - 1).alias("freq")))
    within = one.select(*by, parts.alias("__p")).select(*by, F.inline("__p")).where("value IS NOT NULL AND freq > 0")
    # the number of rows is asked for so that both uses of the times are one plan and share its shuffle
    ends = one.groupBy(*by, CHUNK).agg(F.min("__us").alias("__lo"), F.max("__us").alias("__hi"), F.sum("__c").alias("__rows")).where("__rows > 0")
    across = ends.select(*by, seconds(F.col("__lo") - F.lag("__hi").over(series_window(by, CHUNK))).alias("value"))
    across = across.select("*", F.col("value").isNotNull().cast("bigint").alias("freq"))
    found = union_all([within, across]).groupBy(*by, "value").agg(F.sum("freq").alias("freq"))
    return found.select(*by, F.lit("step").alias("variable"), "value", "freq")


def step_median(df: DataFrame, ts: str, by: Sequence[str] = (), chunk_seconds: int = 21_600) -> DataFrame:
    """Median distance of successive times in seconds, missing for a single time, with the
    least and greatest distance and the number of distances."""
    steps = step_counts(df, ts, by, chunk_seconds)
    v, n = F.col("value"), F.col("freq")
    shape = [F.min(v).alias("least_step"), F.max(v).alias("greatest_step"), F.coalesce(F.sum(n), F.lit(0)).alias("steps")]
    # a condition on the counts stays above their shuffle, which both uses then share
    med = percentiles_of_counts(steps.where(n > 0), by, [0.5]).select(*by, F.col("value").alias("median_step_seconds"))
    g = steps.groupBy(*by).agg(*shape)
    if by:
        return join_keys(g, med, list(by))
    return g.select(med.scalar().alias("median_step_seconds"), "*")


def step_hours(df: DataFrame, ts: str, by: Sequence[str] = (), chunk_seconds: int = 21_600) -> DataFrame:
    """Median distance of successive times in hours; 1.0 where there is none or it is 0."""
    hours = F.col("median_step_seconds") / 3600
    return step_median(df, ts, by, chunk_seconds).select(
        *by, F.when(hours > 0, hours).otherwise(F.lit(1.0)).alias("step_hours"))


def to_energy(value: Column, hours: Column | float, kilo: bool = False) -> Column:
    """Power times step, in Wh or kWh."""
    wh = value * hours
    return wh / 1000.0 if kilo else wh


QUANTILES = {"p10": 0.1, "p90": 0.9}


def daily_stats(df: DataFrame, ts: str, spec: Sequence[tuple[str, str, str]], by: Sequence[str] = (), full: bool = True) -> DataFrame:
    """A block of day statistics, one grouping for all of them and one for the percentiles.

    ``spec`` lists ``(name, column, statistic)``; statistics are sum, mean, min, max, std, p10,
    p90, count (values present) and frac (share of the day's rows that have a value).
    """
    df = df.where(F.col(ts).isNotNull())
    day = floor_time(F.col(ts), "day").alias("date")
    of_day = F.count(F.lit(1))
    want = [s for s in spec if s[2] in QUANTILES]
    aggs = [(F.count(F.col(f"`{c}`")) / of_day if f == "frac" else AGGREGATES[f](F.col(f"`{c}`"))).alias(n)
            for n, c, f in spec if f not in QUANTILES]
    if not want:
        out = df.groupBy(*by, day).agg(*(aggs or [of_day.alias("__rows")]))
    else:
        cols, ps = sorted({c for _, c, _ in want}), sorted({QUANTILES[f] for *_, f in want})
        used = sorted({c for _, c, _ in spec})
        src, keys = df.select(*by, day, *[F.col(f"`{c}`") for c in used if c not in by]), [*by, "date"]
        large = is_large(src.groupBy(*keys).agg(of_day.alias("__m")), keys, "__m")
        aggs += [small_percentile(F.when(~F.col("__large"), F.col(f"`{c}`").cast("double")), ps).alias(f"__q{i}") for i, c in enumerate(cols)]
        out = src.withColumn("__large", large).groupBy(*keys).agg(*aggs)
        q = percentiles_of_columns(src.where(large), cols, ps, keys)
        pick = lambda c, p: F.max(F.when((F.col("variable") == c) & (F.col("p") == p), F.col("value")))
        q = q.groupBy(*keys).agg(*[pick(c, QUANTILES[f]).alias(f"__{n}") for n, c, f in want])
        own = {n: F.coalesce(F.col(f"__q{cols.index(c)}")[ps.index(QUANTILES[f])], F.col(f"`__{n}`")).alias(n) for n, c, f in want}
        out = join_keys(out, q, keys).select(*keys, *[own.get(n, F.col(f"`{n}`")) for n, *_ in spec])
    out = out.select(*by, "date", *[F.col(f"`{n}`") for n, *_ in spec])
    if not full:
        return out
    out = complete(out, "date", "day", by)
    zero = {n for n, _, f in spec if f in ("sum", "count")}
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in zero else F.col(f"`{c}`")
                        for c in out.columns])


# Measure names of the irradiance model and the statistics kept for each.
IRRADIANCE = ("G(i)", "G(h)", "Gb(n)", "Gd(h)", "IR(h)")
POWER = ("P", "P_mapped_Wh", "P_normalized_0_1_Wh")
FULL_BLOCK = ("mean", "min", "max", "std", "p10", "p90")
WEATHER_BLOCKS = {
    "T2m": FULL_BLOCK,
    "RH": FULL_BLOCK,
    "WS10m": ("mean", "max", "std", "p10", "p90"),
    "SP": ("mean",),
    "H_sun": ("max", "mean"),
}
COUNTED = (*POWER, "G(i)", "G(h)", "T2m", "RH", "WS10m", "WD10m", "SP", "H_sun")


def irradiance_spec(columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """The day block for whichever irradiance, power and weather columns are present."""
    have = set(columns)
    spec = []
    for c in (*IRRADIANCE, *POWER):
        if c in have:
            spec.append((f"{c}_Whm2" if c in IRRADIANCE else c, c, "sum"))
            spec += [(f"{c}_{f}", c, f) for f in FULL_BLOCK]
    for c, fs in WEATHER_BLOCKS.items():
        if c in have:
            spec += [(f"{c}_{f}", c, f) for f in fs]
    for c in COUNTED:
        if c in have:
            spec += [(f"n_obs_{c}", c, "count"), (f"valid_frac_{c}", c, "frac")]
    return spec


def daily_direction(df: DataFrame, ts: str, deg: str, weight: str | None = None, by: Sequence[str] = (),
                    strict: bool = False) -> DataFrame:
    """Circular mean, circular deviation and commonest sector of each day.

    The raw rows are reduced to the sums of at most nine sectors per day (eight and unknown);
    everything else is made from those.
    """
    d = F.col(deg)
    w = F.col(weight) if weight else F.lit(None).cast("double")
    sums = sector_sums(d, w)
    per = (df.groupBy(*by, floor_time(F.col(ts), "day").alias("date"), sector_index(d).alias("__s"))
           .agg(*[c.alias(n) for n, c in sums.items()], F.count(d).alias("__n"), F.min(ts).alias("__t")))
    best = F.min(F.when(F.col("__s").isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col("__t").alias("t"), F.col("__s").alias("s"))))
    mean, std = directions_from_sums(weighted=weight is not None, strict=strict)
    return per.groupBy(*by, "date").agg(mean.alias(f"{deg}_circmean"), std.alias(f"{deg}_circstd_deg"),
                                        sector_name(best["s"]).alias(f"{deg}_mode_sector"))


def mode_sector(df: DataFrame, ts: str, deg: str, by: Sequence[str] = ()) -> DataFrame:
    """Commonest of the eight sectors per day, the earliest seen on ties."""
    return daily_direction(df, ts, deg, None, by).select(*by, "date", f"{deg}_mode_sector")


def coverage(df: DataFrame, ts: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values present and their share of the rows, per day and column."""
    spec = [s for c in cols for s in ((f"n_obs_{c}", c, "count"), (f"valid_frac_{c}", c, "frac"))]
    return daily_stats(df, ts, spec, by)


def energy_total(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Total, number of days with a value, first and last date."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.min(date).alias("forecast_start"), F.max(date).alias("forecast_end"),
        F.count(v).alias("days_counted"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total_wh"))


def reconcile(raw: DataFrame, daily: DataFrame, ts: str, value: str, date: str, total: str,
              by: Sequence[str] = (), tol: float = 1e-3) -> DataFrame:
    """Day sums of the raw rows beside the daily table's, with a match flag."""
    g = raw.groupBy(*by, floor_time(F.col(ts), "day").alias(date)).agg(F.sum(value).alias("raw_sum"))
    j = join_keys(g, daily.select(*by, date, F.col(total).alias("daily_sum")), [*by, date])
    ok = F.abs(F.col("raw_sum") - F.col("daily_sum")) < tol
    return j.select(*by, date, "raw_sum", "daily_sum", F.coalesce(ok, F.lit(False)).alias("matches"))
