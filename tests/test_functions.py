import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliochron.functions import calendar as cal
from heliochron.functions.cells import to_number
from heliochron.functions.circular import circular_mean, circular_std
from heliochron.functions.times import date_from_parts, date_from_stamp, floor_time, from_micros, micros, parse_time
from heliochron.operators.clean import type_cells
from heliochron.operators.resample import daily_direction


def one(spark, values, schema, col):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}").orderBy("i").select(col).collect()]


def test_type_cell(spark):
    cells = ["", "  ", None, "1,234", "-7", "+3", "1.50", "1e3", "2024-05-06", "2024/5/6", "2024-05-06 07:08:09", "1799-01-01",
             "2101-01-01", "X", "12:30", "nan", "12345678901234567890"]
    got = [(r.v.kind, r.v.text) for r in type_cells(spark.createDataFrame(list(enumerate(cells)), "i int, v string"), ["v"]).orderBy("i").collect()]
    assert got == [("empty", ""), ("empty", ""), ("empty", ""), ("int", "1234"), ("int", "-7"), ("int", "3"), ("float", "1.5"),
                   ("float", "1000.0"), ("date", "2024-05-06"), ("date", "2024-05-06"), ("time", "2024-05-06 07:08:09"),
                   ("text", "1799-01-01"), ("text", "2101-01-01"), ("text", "X"), ("text", "12:30"), ("float", "NaN"),
                   ("int", "12345678901234567890")]


def test_to_number_never_leaves_nan(spark):
    assert one(spark, ["1", "nan", "X", "", None, " 2.5 "], "string", to_number(F.col("v"))) == [1.0, None, None, None, None, 2.5]


def test_parse_time(spark):
    d = dt.datetime
    cases = {
        "2025-04-23 05:06:07": d(2025, 4, 23, 5, 6, 7), "2025/4/3 1:05": d(2025, 4, 3, 1, 5), "4/23/2025 5:06": d(2025, 4, 23, 5, 6),
        "2025-04-23T05:06:07": d(2025, 4, 23, 5, 6, 7), "20050101:0010": d(2005, 1, 1, 0, 10), "20250423": d(2025, 4, 23), "20250423050607": d(2025, 4, 23, 5, 6, 7), "20250423 0506": d(2025, 4, 23, 5, 6),
        "1745384767": d(2025, 4, 23, 5, 6, 7), "45000": d(1970, 1, 1, 12, 30), "99999999999": None, "soon": None, "": None, None: None,
        "2025-13-01": None, "3000-01-01 00:00:00": d(3000, 1, 1),
    }
    assert one(spark, list(cases), "string", parse_time(F.col("v"))) == list(cases.values())


def test_micros_round_trip(spark):
    ts = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2124, 2, 29, 1, 2, 3, 4), dt.datetime(1970, 1, 1)]
    assert one(spark, ts, "timestamp_ntz", from_micros(micros(F.col("v")))) == ts
    assert one(spark, ts, "timestamp_ntz", micros(F.col("v"))) == [-1, int((ts[1] - ts[2]) / dt.timedelta(microseconds=1)), 0]
    assert one(spark, ts, "timestamp_ntz", floor_time(F.col("v"), "minute"))[1] == dt.datetime(2124, 2, 29, 1, 2)


def test_dates_from_text(spark):
    assert one(spark, ["2024022907", "2023022907", "20", None], "string", date_from_stamp(F.col("v"))) == [dt.date(2024, 2, 29), None, None, None]
    assert one(spark, ["7", "31", "32", None], "string", date_from_parts(F.lit(2024), F.lit(3), F.col("v"))) == [
        dt.date(2024, 3, 7), dt.date(2024, 3, 31), None, None]


def wind(spark, rows):
    return spark.createDataFrame([(g, dt.datetime(2024, 1, 1, i % 24, i // 24), d, w) for i, (g, d, w) in enumerate(rows)],
                                 "g string, ts timestamp_ntz, wd double, ws double")


def test_circular(spark):
    rows = [("wrap", 350.0, 1.0), ("wrap", 10.0, 1.0), ("zero", 90.0, 0.0), ("zero", 180.0, 0.0), ("one", 33.0, 2.0),
            ("heavy", 0.0, 3.0), ("heavy", 90.0, 1.0), ("hole", 0.0, 1.0), ("hole", 90.0, None), ("none", None, 1.0)]
    d, w = F.col("wd"), F.col("ws")
    got = {r.g: r for r in wind(spark, rows).groupBy("g").agg(circular_mean(d, w).alias("m"), circular_std(d, w).alias("s"),
                                                             circular_mean(d, w, strict=True).alias("strict")).collect()}
    assert min(got["wrap"].m, 360 - got["wrap"].m) == pytest.approx(0, abs=1e-9)
    assert got["zero"].m == pytest.approx(135) and got["one"].m == pytest.approx(33)
    assert got["one"].s == pytest.approx(0, abs=1e-4)
    assert got["heavy"].m == pytest.approx(math.degrees(math.atan2(1, 3)))
    assert got["heavy"].s == pytest.approx(math.degrees(math.sqrt(-2 * math.log(math.sqrt(10) / 4))))
    assert got["hole"].m == pytest.approx(0) and got["hole"].strict is None
    assert got["none"].m is None and got["none"].s is None


def test_daily_direction_from_sector_sums(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x) if x < 350 else None, float(w)) for x, w in zip(rng.uniform(0, 360, 60), rng.integers(0, 3, 60))]
    rows += [("tie", 0.0, 1.0), ("tie", 90.0, 1.0), ("north", 340.0, 1.0), ("north", 22.0, 1.0), ("north", 100.0, 1.0)]
    d = wind(spark, rows)
    a = {r.g: r for r in daily_direction(d, "ts", "wd", "ws", ["g"]).collect()}
    b = {r.g: r for r in d.groupBy("g").agg(circular_mean(F.col("wd"), F.col("ws")).alias("m"), circular_std(F.col("wd"), F.col("ws")).alias("s")).collect()}
    for g in b:
        assert a[g].wd_circmean == pytest.approx(b[g].m) and a[g].wd_circstd_deg == pytest.approx(b[g].s)
    assert a["tie"].wd_mode_sector == "N" and a["north"].wd_mode_sector == "N"


def test_dummies_of_a_missing_date(spark):
    d = spark.createDataFrame([(None,), ("2024-07-06",)], "t string").select(F.col("t").cast("date").alias("d"))
    r = d.select(*[c.alias(n) for n, c in {**cal.dummies(F.col("d")), **cal.harmonics(F.col("d"))}.items()]).collect()
    assert sum(v for k, v in r[0].asDict().items() if k.startswith(("month", "season", "is_"))) == 0
    assert r[0].sin_DOY_k1 == 0 and r[0].cos_DOY_k3 == 1
    assert r[1].month_7 == 1 and r[1].season_summer == 1 and r[1].is_weekend == 1 and r[1].month_6 == 0
