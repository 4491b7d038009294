"""Irradiance-model hours (UTC) to local days, and their comparison scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import join_keys
from ..operators.resample import FULL_BLOCK, IRRADIANCE, POWER, daily_direction, daily_stats, irradiance_spec, step_hours


def irradiance_days(df: DataFrame, ts_utc: str = "time_utc", by: Sequence[str] = (), tz: str = "Asia/Taipei") -> DataFrame:
    """The whole day block for the measures present.

    Energies are day sums times the series' median step: the step does not vary within a
    series, so the multiplication waits until the rows are days.
    """
    measures = [c for c in df.columns if c not in (ts_utc, *by)]
    local = df.select(*by, F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts_utc)).alias("local_time"),
                      *[F.col(f"`{c}`") for c in measures])
    d = daily_stats(local, "local_time", irradiance_spec(measures), by)
    step = step_hours(local, "local_time", by)
    d = join_keys(d, step, list(by)) if by else d.withColumn("step_hours", step.select("step_hours").scalar())
    h, new = F.col("step_hours"), {}
    for c in measures:
        if c in IRRADIANCE:
            new[f"{c}_Whm2"] = F.col(f"`{c}_Whm2`") * h
            new[f"{c}_kWhm2"] = F.col(f"`{c}_Whm2`") * h / 1000.0
            if c == "G(i)":
                new["Hpoa_day_kWhm2"] = new[f"{c}_kWhm2"]
        elif c in POWER:
            new[c] = F.col(f"`{c}`") * h
            new[f"{c}_kWh"] = F.col(f"`{c}`") * h / 1000.0
            if c == "P":
                new["E_day_kWh"] = new[f"{c}_kWh"]
    cols = [c for c in d.columns if c not in (*by, "date", "step_hours")]
    d = d.select(*by, "date", F.dayofyear("date").alias("doy"), F.month("date").alias("month"), F.day("date").alias("day"),
                 *[new.pop(c, F.col(f"`{c}`")).alias(c) for c in cols], *[v.alias(k) for k, v in new.items()])
    if "WD10m" in measures:
        wind = daily_direction(local, "local_time", "WD10m", "WS10m" if "WS10m" in measures else None, by)
        d = join_keys(d, wind, [*by, "date"])
    return d


def typical_year_days(df: DataFrame, ts_utc: str = "time_utc", by: Sequence[str] = (), tz: str = "Asia/Taipei") -> DataFrame:
    """The day block under a typical year's names: ``P_Wh``, ``P_mean_W``, ``G(i)_std_Wm2`` and so on.

    Cells that are no numbers are missing, and the model's flag ``Int`` goes before anything is counted.
    """
    measures = [c for c in df.columns if c not in (ts_utc, *by, "Int")]
    d = irradiance_days(df.select(*by, ts_utc, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in measures]), ts_utc, by, tz)
    new = {"P": "P_Wh", **{f"P_{f}": f"P_{f}_W" for f in FULL_BLOCK}}
    new |= {f"{c}_{f}": f"{c}_{f}_Wm2" for c in IRRADIANCE for f in ("std", "p10", "p90")}
    gone = {"doy", "month", "day", "E_day_kWh", "Hpoa_day_kWhm2"}
    return d.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in d.columns if c not in gone])
