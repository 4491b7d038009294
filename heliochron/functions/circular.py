"""Aggregate expressions for directions in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight wind sectors, clockwise from north.
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def sector_sums(deg: Column, weight: Column) -> dict[str, Column]:
    """Sums that add up over parts of a group; :func:`directions_from_sums` takes them."""
    rad, has = F.radians(deg), deg.isNotNull()
    w = F.when(has, weight)
    return {
        "__x1": F.sum(F.when(has, F.cos(rad))), "__y1": F.sum(F.when(has, F.sin(rad))), "__w1": F.count(deg),
        "__xw": F.sum(w * F.cos(rad)), "__yw": F.sum(w * F.sin(rad)), "__ww": F.sum(w),
        "__top": F.max(F.abs(w)), "__gap": F.count(F.when(has & weight.isNull(), 1)),
    }


def _direction(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def _spread(x: Column, y: Column, w: Column) -> Column:
    r = F.try_divide(F.sqrt(x * x + y * y), w)
    # greatest/least would skip a missing length, so keep it missing by hand
    r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(1e-12)), F.lit(1.0)))
    return F.degrees(F.sqrt(-2.0 * F.ln(r)))


def directions_from_sums(weighted: bool, strict: bool) -> tuple[Column, Column]:
    """(mean, deviation) aggregates over rows of :func:`sector_sums`."""
    ones = tuple(F.sum(c) for c in ("__x1", "__y1", "__w1"))
    if not weighted:
        x, y, w = ones
        return _direction(x, y), _spread(x, y, w)
    all_zero, gap = F.max("__top") == 0, F.sum("__gap") > 0
    parts = tuple(F.sum(c) for c in ("__xw", "__yw", "__ww"))
    if strict:  # one missing weight makes the whole group missing
        parts = tuple(F.when(~gap, p) for p in parts)
    x, y, w = (F.when(all_zero, o).otherwise(p) for o, p in zip(ones, parts))
    return _direction(x, y), _spread(x, y, w)


def _resultant(deg: Column, weight: Column | None, strict: bool):
    """Weighted x, y and total weight; weights that are all zero count as ones."""
    s = sector_sums(deg, F.lit(None).cast("double") if weight is None else weight)
    ones = (s["__x1"], s["__y1"], s["__w1"])
    if weight is None:
        return ones
    parts = (s["__xw"], s["__yw"], s["__ww"])
    if strict:
        parts = tuple(F.when(s["__gap"] == 0, p) for p in parts)
    return tuple(F.when(s["__top"] == 0, o).otherwise(p) for o, p in zip(ones, parts))


def circular_mean(deg: Column, weight: Column | None = None, strict: bool = False) -> Column:
    """Mean direction in [0, 360) of a group.

    A row without a weight is left out; with ``strict`` it makes the group missing.
    """
    x, y, _ = _resultant(deg, weight, strict)
    return _direction(x, y)


def circular_std(deg: Column, weight: Column | None = None, strict: bool = False) -> Column:
    """Circular standard deviation in degrees, from the mean resultant length."""
    return _spread(*_resultant(deg, weight, strict))


def sector_index(deg: Column) -> Column:
    """0 (north) to 7, each sector 45 degrees wide around its direction."""
    return F.pmod(F.floor((deg + 22.5) / 45).cast("int"), F.lit(8))


def sector_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), index + 1)
