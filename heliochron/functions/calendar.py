"""Calendar features of a date column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(d: Column) -> dict[str, Column]:
    """Weekday (Monday 0), weekend flag, month, day of year and its yearly wave."""
    doy = F.dayofyear(d)
    angle = doy * (2 * math.pi) / 365.25
    return {
        "dayofweek": F.weekday(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "month": F.month(d),
        "dayofyear": doy,
        "dayofyear_sin": F.sin(angle),
        "dayofyear_cos": F.cos(angle),
    }


def harmonics(d: Column, ks: Sequence[int] = (1, 2, 3), year_days: float = 365.0) -> dict[str, Column]:
    """sin/cos of the day of year at each k; a missing date counts as day 0."""
    doy = F.coalesce(F.dayofyear(d), F.lit(0)).cast("double")
    out = {}
    for k in ks:
        angle = doy * (2 * math.pi * k) / year_days
        out[f"sin_DOY_k{k}"] = F.sin(angle)
        out[f"cos_DOY_k{k}"] = F.cos(angle)
    return out


def season(d: Column) -> Column:
    """Season of the month; a missing date is winter."""
    m = F.coalesce(F.month(d), F.lit(0))
    return (F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer")
            .when(m.between(9, 11), "autumn").otherwise("winter"))


def dummies(d: Column) -> dict[str, Column]:
    """0/1 columns for months 2-12, three seasons (winter is the base) and the weekend."""
    m = F.coalesce(F.month(d), F.lit(0))
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    out = {f"month_{i}": flag(m == i) for i in range(2, 13)}
    out |= {f"season_{s}": flag(season(d) == s) for s in ("autumn", "spring", "summer")}
    out["is_weekend"] = flag(F.coalesce(F.weekday(d), F.lit(0)) >= 5)
    return out
