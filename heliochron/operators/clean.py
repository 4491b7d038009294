"""Projection, coercion, de-duplication and timestamp repair."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import cell_parts, null_if, to_number, type_cell
from ..functions.times import from_micros, micros, parse_time
from .ordered import CHUNK, chunk_by_number, join_keys, series_window

# Names under which a time column is looked for, exact first, then as part.
TIME_NAMES = ("datetime", "date", "time", "timestamp", "local_time", "localtime", "Date", "Time")
TIME_PARTS = ("date", "time", "datetime", "timestamp", "local")
PROFILE_PARTS = ("time", "date", "timestamp", "datetime", "ts", "local")
VALUE_NAMES = ("Wh_pred", "Wh")


def type_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each text column as ``struct(kind, text)``; see :func:`type_cell`."""
    parts = {c: F.struct(*[v.alias(n) for n, v in cell_parts(F.col(f"`{c}`")).items()]) for c in cols}
    d = df.select("*", *[p.alias(f"__p{i}") for i, p in enumerate(parts.values())])
    typed = {c: type_cell(F.col(f"__p{i}")) for i, c in enumerate(cols)}
    return d.select(*[typed[c].alias(c) if c in typed else F.col(f"`{c}`") for c in df.columns])


def to_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All (or the named) columns as DOUBLE, unreadable cells missing."""
    cols = set(df.columns if cols is None else cols)
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def replace_sentinels(df: DataFrame, values: Iterable[str] = ("X", ""),
                      cols: Sequence[str] | None = None) -> DataFrame:
    """Sentinel texts to missing in all (or the named) string columns."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cols = text if cols is None else set(cols) & text
    return df.select(*[null_if(F.col(f"`{c}`"), values).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def find_time_column(df: DataFrame) -> str | None:
    """First exact known name, else the first column whose name holds a known part."""
    for c in df.columns:
        if c in TIME_NAMES:
            return c
    for part in TIME_PARTS:
        for c in df.columns:
            if part in c.lower():
                return c
    return None


def detect_time_column(df: DataFrame, share: float = 0.3) -> str | None:
    """A column typed as time, else a likely name that parses in ``share`` of the rows, else
    the first column if anything in it parses.  One aggregate row decides."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
    if not df.columns:
        return None
    named = [c for c in df.columns if any(p in c.lower() for p in PROFILE_PARTS)]
    probe = list(dict.fromkeys([*named, df.columns[0]]))
    row = df.agg(F.count(F.lit(1)), *[F.count(parse_time(F.col(f"`{c}`").cast("string")))
                                      for c in probe]).first()
    hits = dict(zip(probe, row[1:]))
    for c in named:
        if hits[c] >= max(1, int(row[0] * share)):
            return c
    return df.columns[0] if hits[df.columns[0]] > 0 else None


def mode_year(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent year per series, the smallest on ties."""
    n = (df.where(F.col(ts).isNotNull()).groupBy(*by, F.year(ts).alias("__y"))
         .agg(F.count(F.lit(1)).alias("__n")))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__y").alias("y")))
    return n.groupBy(*by).agg(best["y"].alias("mode_year"))


def rename_ci(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename ignoring case, unless the new name is already there."""
    if new in df.columns:
        return df
    hit = next((c for c in df.columns if c.lower() == old.lower()), None)
    return df.withColumnRenamed(hit, new) if hit else df


def keep(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the given order; absent ones are ignored."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Everything but the named columns; absent ones are ignored."""
    return df.drop(*[c for c in names if c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all (one aggregate row decides)."""
    row = df.agg(*[F.count(F.col(f"`{c}`")) for c in df.columns]).first()
    return drop(df, [c for c, n in zip(df.columns, row) if n == 0])


def dropna(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows with a value in every (``any``) or at least one (``all``) of the columns."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in ``order``.

    An aggregate rather than a ranking window, so copies of a hot key are reduced before the
    shuffle.
    """
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("__r"))
    return best.select(*[F.col("__r")[c].alias(c) for c in df.columns])


def between(df: DataFrame, col: str, start, end) -> DataFrame:
    """Closed range filter; plain literals are pushed to the scan."""
    return df.where(F.col(col).between(start, end))


def pick_value_column(df: DataFrame, skip: Sequence[str] = ("date",)) -> str | None:
    """``Wh_pred``, else ``Wh``, else the first numeric column."""
    for n in VALUE_NAMES:
        if n in df.columns:
            return n
    numeric = (T.NumericType,)
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, numeric)
                 and f.name.lower() not in skip), None)


def _minutes(n: Column) -> Column:
    return n.cast("bigint") * F.lit(60_000_000)


def repair_timestamps(df: DataFrame, ts: str, order_by: str, by: Sequence[str] = (),
                      max_year: int = 2060, out: str = "fixed_time",
                      chunk_rows: int = 1_000_000) -> DataFrame:
    """Rebase every contiguous run of bad times onto the time before it.

    A time is bad when missing or later than ``max_year``.  A run starts one minute after the
    last good time (or at New Year of the commonest year) and keeps its own spacing; rows
    without a time follow the row before by one minute.  If the run's first row has no time,
    the whole run is laid out one minute apart.

    ``order_by`` is the row's number in the file.  Runs may cross chunk borders: each chunk
    hands on its row count, its last good row and the state of the run left open at its end.
    """
    keys = [*by, CHUNK]
    d = df.select("*", micros(F.col(ts)).alias("__t"),
                  F.coalesce(F.year(ts) > max_year, F.lit(True)).alias("__bad"),
                  chunk_by_number(order_by, chunk_rows).alias(CHUNK))
    w = Window.partitionBy(*keys).orderBy(order_by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bad, t, n = F.col("__bad"), F.col("__t"), F.col("__n")

    # inside a chunk: position, last good row, first row of the run, last timed row of the run
    local = d.select("*", F.row_number().over(w).cast("bigint").alias("__n"),
                     F.lag(bad).over(w).alias("__was_bad"))
    here = F.struct(t.alias("t"), n.alias("n"))
    local = local.select(
        "*",
        F.last(F.when(~bad, here), True).over(upto).alias("__good"),
        F.last(F.when(bad & (F.col("__was_bad").isNull() | ~F.col("__was_bad")),
                      F.struct(t.alias("t"))), True).over(upto).alias("__start"),
        F.last(F.when(bad & t.isNotNull(), here), True).over(upto).alias("__timed"))

    # one summary row per chunk, then the state at the end of each chunk, in order
    tail = F.max_by(F.struct("__n", "__bad", "__good", "__start", "__timed"), F.col(order_by))
    s = local.groupBy(*keys).agg(tail.alias("e")).select(*keys, "e.*")
    seq = series_window(by, CHUNK)
    s = s.select("*", (F.sum("__n").over(seq) - F.col("__n")).alias("__off"),
                 F.sum(F.col("__good").isNotNull().cast("int")).over(seq).alias("__grp"))
    shift = lambda c: F.when(c.isNotNull(), F.struct(c["t"].alias("t"), (c["n"] + F.col("__off")).alias("n")))
    open_run = F.col("__bad")
    in_run = F.col("__good").isNull() | (F.col("__timed")["n"] > F.col("__good")["n"])
    s = s.select("*", shift(F.col("__good")).alias("g"),
                 F.when(open_run, F.col("__start")).alias("f"),
                 F.when(open_run & in_run, shift(F.col("__timed"))).alias("p"))
    run = series_window([*by, "__grp"], CHUNK)
    s = s.select(*keys, "__off", F.last("g", True).over(seq).alias("g"),
                 F.first("f", True).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("f"),
                 F.last("p", True).over(run).alias("p"))
    carry = s.select(*keys, "__off", *[F.lag(c).over(seq).alias(f"__in_{c}") for c in ("g", "f", "p")])
    year = mode_year(df, ts, by)
    if by:
        carry = join_keys(carry, year, list(by))
    else:
        carry = carry.withColumn("mode_year", year.scalar())

    x = join_keys(local, carry, keys)
    inside = F.col("__good").isNotNull()
    new_year = micros(F.make_date(F.col("mode_year"), F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    at = n + F.col("__off")
    base = F.when(inside, F.col("__good")["t"] + F.lit(60_000_000)).otherwise(
        F.coalesce(F.col("__in_g")["t"] + F.lit(60_000_000), new_year))
    first_n = F.when(inside, F.col("__good")["n"] + F.col("__off") + 1).otherwise(
        F.coalesce(F.col("__in_g")["n"], F.lit(0)) + 1)
    start = F.when(inside | F.col("__in_f").isNull(), F.col("__start")).otherwise(F.col("__in_f"))
    timed_t = F.coalesce(F.col("__timed")["t"], F.col("__in_p")["t"])
    timed_n = F.coalesce(F.col("__timed")["n"] + F.col("__off"), F.col("__in_p")["n"])
    fixed = (F.when(~bad, t)
             .when(start["t"].isNotNull(), base + (timed_t - start["t"]) + _minutes(at - timed_n))
             .otherwise(base + _minutes(at - first_n)))
    return x.select(*df.columns, from_micros(fixed).alias(out))


def repair_log(repaired: DataFrame, original: str, ts: str, fixed: str = "fixed_time") -> DataFrame:
    """The rows whose time was changed, with the original text beside the new time."""
    return (repaired.where(~F.col(ts).eqNullSafe(F.col(fixed)))
            .withColumn("original_text", F.col(original).cast("string")))


def clean_name(name: str) -> str:
    """Column name trimmed, blanks and full-width opening brackets to ``_``, closing ones gone."""
    # The signs replaced and removed.
    return re.sub("）", "", re.sub("[ （]", "_", name.strip()))


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


