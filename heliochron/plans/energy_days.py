"""Logger minutes to model-ready days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_time
from ..operators import clean
from ..operators.align import left_join_days
from ..operators.features import add_dummies, add_harmonics
from ..operators.resample import daily_energy, fill_hour_of_day, resample

# The logger's columns in file order.
LOGGER_COLUMNS = ("LocalTime", "W", "DHT11_temp", "DHT11_humidity", "LM35_tempC", "INA219_busVoltage_V",
                  "INA219_shuntVoltage_mV", "INA219_current_mA", "INA219_power_mW", "ACS712_20A_current_A")


def minutes_to_days(df: DataFrame, ts: str, power: str, measures: Sequence[str], by: Sequence[str] = (),
                    digits: int | None = None) -> DataFrame:
    """Minute rows to hours (gaps filled by clock hour) to days.

    The mean power of an hour is its energy in Wh.  ``digits`` rounds the hours first, as the
    hourly file does.
    """
    cols = [power, *measures]
    h = resample(df.select(*by, ts, *cols), ts, "hour", {c: "mean" for c in cols}, by)
    h = fill_hour_of_day(h, ts, cols, by)
    if digits is not None:
        h = h.select(*by, ts, *[F.round(c, digits).alias(c) for c in cols])
    h = h.withColumnRenamed(power, "Wh") if power != "Wh" else h
    return daily_energy(h, ts, ["Wh"], measures, by)


def logger_days(lines: DataFrame, order_by: str, by: Sequence[str] = (), time_col: str = "LocalTime",
                power: str = "W", measures: Sequence[str] = ("DHT11_temp", "DHT11_humidity", "LM35_tempC"),
                digits: int | None = 5) -> DataFrame:
    """Raw text rows of the logger to days: headers out, numbers coerced, times repaired, resampled."""
    from ..sources.readers import drop_repeated_headers
    d = drop_repeated_headers(lines, time_col)
    d = clean.to_numeric(d, [c for c in (power, *measures)])
    d = d.withColumn("__parsed", parse_time(F.col(time_col)))
    d = clean.repair_timestamps(d, "__parsed", order_by, by)
    return minutes_to_days(d, "fixed_time", power, measures, by, digits).withColumnRenamed("fixed_time", time_col)


def with_weather(days: DataFrame, weather: DataFrame, left_on: str = "LocalTime", right_on: str = "Date",
                 by: Sequence[str] = ()) -> DataFrame:
    """Energy days beside weather days and their calendar columns."""
    w = add_dummies(add_harmonics(weather, right_on), right_on)
    return left_join_days(days, w, left_on, right_on, by)
