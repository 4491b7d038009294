"""Ordered operators that do not need a whole series in one task.

Two kinds of input occur:

* **calendar tables** hold at most one row per series and step, so a series is as long as
  its calendar (3,653 days or 87,672 hours in ten years), whatever share of the raw rows it
  had.  A window by series is bounded there.
* **raw tables** have no such bound.  They are cut into chunks of a fixed width along the
  order column, each chunk is worked on alone, one summary row per chunk is passed on in
  order, and the carried value is joined back.  Rows of a hot series spread over as many
  tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.times import MICROS, micros

CHUNK = "__chunk"


def series_window(by: Sequence[str], *order) -> WindowSpec:
    """Window over one series of a calendar table, in time order."""
    keys = list(by) if by else [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(*order)


def chunk_by_number(order_col: str, width: int) -> Column:
    """Chunk of a row number: at most ``width`` rows of a series share one."""
    return F.floor(F.col(order_col) / F.lit(width)).cast("bigint")


def chunk_by_time(ts: str, width_seconds: int) -> Column:
    """Chunk of a time: one fixed span of the clock."""
    return F.floor(micros(F.col(ts)) / F.lit(width_seconds * 1_000_000)).cast("bigint")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", plain: Sequence[str] = (CHUNK,)) -> DataFrame:
    """Equi-join in which missing keys match each other; right keys are dropped.

    Keys in ``plain`` are never missing and are compared as they are: a side that lies partitioned by
    such a key already, as a window or an aggregate leaves it, is not dealt out again.
    """
    ren = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(f"`{c}`").alias(ren.get(c, c)) for c in right.columns])
    cond = None
    for k, rk in ren.items():
        one = left[f"`{k}`"] == r[rk] if k in plain else left[f"`{k}`"].eqNullSafe(r[rk])
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*ren.values())


def fill_by_chunk(df: DataFrame, cols: Sequence[str], order: str, chunk: Column,
                  by: Sequence[str] = (), forward: bool = True) -> DataFrame:
    """Last (or next) known value of each column along ``order``, chunk by chunk."""
    keys = [*by, CHUNK]
    d = df.withColumn(CHUNK, chunk)
    pick = F.max_by if forward else F.min_by
    edge = d.groupBy(*keys).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__e{i}")
          for i, c in enumerate(cols)])
    step = F.col(CHUNK).asc() if forward else F.col(CHUNK).desc()
    before = series_window(by, step).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*keys, *[F.last(f"__e{i}", True).over(before).alias(f"__k{i}")
                                 for i in range(len(cols))])
    o = F.col(order).asc() if forward else F.col(order).desc()
    inside = Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.last(c, True).over(inside).alias(f"__l{i}")
                            for i, c in enumerate(cols)])
    out = join_keys(local, carry, keys)
    filled = {c: F.coalesce(F.col(f"__l{i}"), F.col(f"__k{i}")) for i, c in enumerate(cols)}
    return out.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def previous_by_chunk(df: DataFrame, value: str, order: str, chunk: Column,
                      by: Sequence[str] = (), out: str = "previous") -> DataFrame:
    """Value of the row just before, across chunk borders."""
    keys = [*by, CHUNK]
    d = df.withColumn(CHUNK, chunk)
    last = d.groupBy(*keys).agg(F.max_by(value, order).alias("__v"))
    carry = last.select(*keys, F.lag("__v").over(series_window(by, CHUNK)).alias("__k"))
    inside = Window.partitionBy(*keys).orderBy(order)
    local = d.select("*", F.lag(value).over(inside).alias("__l"),
                     F.row_number().over(inside).alias("__n"))
    return join_keys(local, carry, keys).select(
        *df.columns, F.when(F.col("__n") == 1, F.col("__k")).otherwise(F.col("__l")).alias(out))


def row_numbers(df: DataFrame, order: str, chunk: Column, by: Sequence[str] = (),
                out: str = "row_number") -> DataFrame:
    """Dense 1-based position of each row in its series."""
    keys = [*by, CHUNK]
    d = df.withColumn(CHUNK, chunk)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = series_window(by, CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    off = n.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys).orderBy(order)
    local = d.withColumn("__rn", F.row_number().over(inside))
    return join_keys(local, off, keys).select(
        *df.columns, (F.col("__rn") + F.col("__off")).cast("bigint").alias(out))


def with_halo(df: DataFrame, ts: str, step: str, width: int, reach: int) -> DataFrame:
    """Give each chunk of ``width`` steps a copy of the ``reach`` rows before it.

    Needs one row per step (a full spine).  Adds ``__chunk`` and ``__halo``; drop the rows
    with ``__halo`` after the window is computed.
    """
    if reach > width:
        raise ValueError("a chunk must be at least as wide as the reach of the window")
    idx = F.floor(micros(F.col(ts)) / F.lit(MICROS[step])).cast("bigint")
    own = F.floor(idx / F.lit(width)).cast("bigint")
    tail = F.pmod(idx, F.lit(width)) >= width - reach
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.select("*", own.alias("__own"), F.explode(homes).alias(CHUNK))
            .select(*df.columns, CHUNK, (F.col(CHUNK) != F.col("__own")).alias("__halo")))
