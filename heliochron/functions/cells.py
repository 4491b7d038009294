"""Typing and coercion of single text cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import parse_dashed


def no_nan(c: Column) -> Column:
    """NaN as missing: a NaN left in place would poison sums and count as a value."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """DOUBLE where the cell reads as a number, else missing; suffixes such as 1d or 5f are no part of one."""
    text = c.cast("string")
    return F.when(~text.rlike(r"[dDfF]\s*$") | text.rlike(r"(?i)inf\s*$"), no_nan(c.try_cast("double")))


def null_if(c: Column, values: Iterable[str]) -> Column:
    """Missing where the text equals one of the sentinels."""
    return F.when(~c.isin(list(values)), c)


def cell_parts(c: Column) -> dict[str, Column]:
    """What :func:`type_cell` looks at, to be computed once per cell by an earlier projection."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    bare = F.translate(raw, ",", "")
    when = F.when(raw.rlike(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"), parse_dashed(raw))
    return {
        "raw": raw,
        "whole": F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("decimal(38,0)")),
        "real": F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$"),
                       bare.try_cast("double")),
        "when": when,
    }


def type_cell(parts: Column) -> Column:
    """``struct(kind, text)`` of a raw cell, given the struct of :func:`cell_parts`.

    kind is ``empty``, ``int``, ``float``, ``date``, ``time`` or ``text``; text is the
    canonical spelling.  Commas are thousands marks and go; a date counts only for years
    1800 to 2100, and midnight is written as a bare date.
    """
    raw, whole, real, when = (parts[n] for n in ("raw", "whole", "real", "when"))
    dated = F.year(when).between(1800, 2100)
    midnight = when == when.cast("date").cast("timestamp_ntz")
    cell = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    return (
        F.when(raw == "", cell("empty", F.lit("")))
        .when(whole.isNotNull(), cell("int", whole.cast("string")))
        .when(real.isNotNull(), cell("float", real.cast("string")))
        .when(dated & midnight, cell("date", F.date_format(when, "yyyy-MM-dd")))
        .when(dated, cell("time", F.date_format(when, "yyyy-MM-dd HH:mm:ss")))
        .otherwise(cell("text", raw))
    )
