"""Zone-free time arithmetic on TIMESTAMP_NTZ columns, and time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}

# Fixed value: last second that a 64-bit nanosecond clock can hold.
LAST_CLOCK_SECOND = 9_223_372_036


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a naive time, independent of the session zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * F.lit(MICROS["day"])
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * F.lit(1_000_000)
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def from_micros(us: Column) -> Column:
    """Inverse of :func:`micros`."""
    secs = (us.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(zero, zero, zero, secs)


def floor_time(ts: Column, step: str) -> Column:
    """Start of the minute, hour, day or month; days and months are DATE, the rest NTZ."""
    if step == "day":
        return ts.cast("date")
    if step == "month":
        return F.trunc(ts.cast("date"), "month")
    zero = F.lit(0)
    midnight = ts.cast("date").cast("timestamp_ntz")
    if step == "hour":
        return midnight + F.make_dt_interval(zero, F.hour(ts))
    if step == "minute":
        return midnight + F.make_dt_interval(zero, F.hour(ts), F.minute(ts))
    raise ValueError(f"unknown step {step!r}")


def step_interval(step: str) -> Column:
    """The length of a step as an interval that can be added or given to ``sequence``."""
    return F.expr({"month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY",
                   "hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}[step])


def parse_dashed(t: Column) -> Column:
    """ISO, year-first with slashes, or month-first with slashes; one pattern runs per row."""
    as_time = lambda c: c.try_cast("timestamp_ntz")
    return (F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), as_time(t))
            .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), as_time(F.translate(t, "/", "-")))
            .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"),
                  as_time(F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"))))


def parse_time(text: Column) -> Column:
    """Text to naive time: the forms of :func:`parse_dashed`, ``yyyymmdd`` with an optional
    ``hhmm`` or ``hhmmss``, else bare digits as epoch seconds.  Digits past the last clock
    second are past the last spreadsheet day as well and stay missing."""
    t = F.trim(text)
    short = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    long = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})[: T]?(\d{2})(\d{2})(\d{2})?$", "$1-$2-$3 $4:$5:0$6")
    compact = F.when(t.rlike(r"^\d{8}$"), short.try_cast("timestamp_ntz")).when(
        t.rlike(r"^\d{8}[: T]?\d{4}(\d{2})?$"), F.regexp_replace(long, r":0(\d{2})$", ":$1").try_cast("timestamp_ntz"))
    digits = F.floor(t.try_cast("double"))
    epoch = F.when(t.rlike(r"^(\d+\.?\d*|\.\d+)$") & (digits <= F.lit(LAST_CLOCK_SECOND)),
                   from_micros(digits.cast("bigint") * F.lit(1_000_000)))
    return F.when(t.rlike(r"^\d{1,4}[-/]"), parse_dashed(t)).otherwise(F.coalesce(compact, epoch))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """DATE from text or numeric parts, missing where they name no day."""
    txt = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"),
                      F.lpad(F.trim(month.cast("string")), 2, "0"),
                      F.lpad(F.trim(day.cast("string")), 2, "0"))
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, txt.try_cast("date"))


def date_from_stamp(text: Column) -> Column:
    """DATE from the first eight digits of a ``yyyymmddhh`` text."""
    t = text.cast("string")
    return date_from_parts(F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))


def date_text(ts: Column) -> Column:
    """``YYYY-MM-DD`` text of a date or time."""
    return F.date_format(ts.cast("date"), "yyyy-MM-dd")
