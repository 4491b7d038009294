"""Cleaning, resampling, alignment, features and scaling on small tables worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliochron.operators import align as al
from heliochron.operators import clean
from heliochron.operators import features as fe
from heliochron.operators import resample as rs
from heliochron.operators import scaling as sc

D = lambda s: dt.date.fromisoformat(s)
H = lambda s: dt.datetime.fromisoformat(s)


def days(spark, rows, key=False):
    """(day, y) rows or (series, day, y) rows."""
    cols = "s string, " if key else ""
    return spark.createDataFrame(rows, cols + "ds date, y double")


def test_find_and_pick_columns(spark):
    e = lambda *c: spark.createDataFrame([], ", ".join(f"`{x}` string" for x in c))
    assert clean.find_time_column(e("a", "localtime", "Date")) == "localtime"
    assert clean.find_time_column(e("a", "myTimeX", "UpDate")) == "UpDate"
    assert clean.find_time_column(e("a", "LocalTime")) == "LocalTime" and clean.find_time_column(e("a")) is None
    assert clean.pick_value_column(spark.createDataFrame([], "Date int, a string, b int, Wh double")) == "Wh"
    assert clean.pick_value_column(spark.createDataFrame([], "Date int, a string, b int")) == "b"
    d = spark.createDataFrame([("x", "2024-01-01", "q"), ("y", "2024-01-02", "q"), ("z", "no", "q")], "dates string, stamp_ts string, other string")
    assert clean.detect_time_column(d) == "stamp_ts"
    assert clean.detect_time_column(d.select("other")) is None


def test_mode_year_tie_takes_the_smallest(spark):
    d = days(spark, [(D("2021-01-01"), 1.0), (D("2020-01-01"), 1.0), (D("2021-05-01"), 1.0), (D("2020-07-01"), 1.0), (D("2019-01-01"), 1.0)])
    assert clean.mode_year(d, "ds").first()[0] == 2020


def test_dedupe_and_rename(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "q")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in clean.dedupe(d, ["k"], ["o"]).collect()} == {("a", 3, None), ("b", 1, "q")}
    assert {(r.k, r.o) for r in clean.dedupe(d, ["k"], ["o"], "first").collect()} == {("a", 1), ("b", 1)}
    w = spark.createDataFrame([], "w int, Wh int")
    assert clean.rename_ci(w, "W", "Wh").columns == ["w", "Wh"] and clean.rename_ci(w.drop("Wh"), "W", "Wh").columns == ["Wh"]
    assert clean.clean_name("  總 發電（kWh） ") == "總_發電_kWh"


def test_resample_sum_is_zero_and_mean_is_missing_in_gaps(spark):
    d = spark.createDataFrame([("a", H("2024-01-01T00:10"), 2.0), ("a", H("2024-01-01T00:50"), 4.0), ("a", H("2024-01-01T03:00"), 5.0),
                               ("b", H("2024-01-02T07:00"), 1.0)], "s string, ts timestamp_ntz, v double").withColumn("w", F.col("v"))
    got = rs.resample(d, "ts", "hour", {"v": "mean", "w": "sum"}, ["s"]).orderBy("s", "ts").collect()
    assert [(r.s, r.ts.hour, r.v, r.w) for r in got] == [("a", 0, 3.0, 6.0), ("a", 1, None, 0.0), ("a", 2, None, 0.0), ("a", 3, 5.0, 5.0), ("b", 7, 1.0, 1.0)]


@pytest.mark.parametrize("step,freq,kind", [("day", "D", "date"), ("hour", "h", "timestamp_ntz"), ("month", "MS", "date")])
def test_complete_opens_every_gap(spark, step, freq, kind):
    full = pd.date_range("2023-11-01", periods=60, freq=freq)
    some = [full[i] for i in (0, 1, 5, 6, 30, 59)]
    d = spark.createDataFrame([(t.to_pydatetime(), 1.0) for t in some], "t timestamp_ntz, y double").select(F.col("t").cast(kind).alias("t"), "y")
    got = rs.complete(d, "t", step).orderBy("t").toPandas()
    assert list(pd.to_datetime(got["t"])) == list(full) and got["y"].notna().sum() == 6


def test_monthly_energy_keeps_empty_months(spark):
    d = days(spark, [(D("2024-01-31"), 1.0), (D("2024-04-01"), 2.0)])
    assert [(r.month, r.y_sum) for r in rs.monthly_energy(d, "ds", "y").orderBy("month").collect()] == [
        ("2024-01", 1.0), ("2024-02", 0.0), ("2024-03", 0.0), ("2024-04", 2.0)]


def test_clock_hour_fill(spark):
    rows = [(H(f"2024-01-0{d}T{h:02d}:00"), None if (d, h) == (2, 5) else float(d * 10 + h)) for d in (1, 2, 3) for h in (5, 6)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = {r.ts: r.v for r in rs.fill_hour_of_day(d, "ts", ["v"]).collect()}
    assert got[H("2024-01-02T05:00")] == 25.0 and got[H("2024-01-02T06:00")] == 26.0


def test_minutes_to_days_rounds_hours_when_asked(spark):
    from heliochron.plans.energy_days import logger_days, minutes_to_days
    rows = [(H(f"2024-01-01T{h:02d}:{m:02d}"), 1 / 3) for h in range(3) for m in (0, 30)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, W double")
    assert minutes_to_days(d, "ts", "W", []).first().Wh == pytest.approx(1.0, abs=1e-12)
    assert minutes_to_days(d, "ts", "W", [], digits=5).first().Wh == pytest.approx(0.99999, abs=1e-12)
    raw = spark.createDataFrame([(0, "LocalTime", "W"), (1, "2024-01-01 00:00:00", "6"), (2, "2160-01-01 00:00:00", "8"), (3, "bad", "1"),
                                 (4, "2024-01-01 01:10:00", "X"), (5, "2024-01-01 02:00:00", "2")], "n long, LocalTime string, W string")
    # hours 5, (gap filled with the mean of clock hour 1: none known), 2
    r = logger_days(raw, "n", measures=()).collect()
    assert len(r) == 1 and r[0].Wh == 7.0 and r[0].LocalTime == D("2024-01-01")


def test_left_join_and_merge(spark):
    a = spark.createDataFrame([("2024-01-01", 1.0, 5), (None, 2.0, 6)], "Date string, Wh double, n int")
    b = spark.createDataFrame([("2024-01-02", 7.0), (None, 9.0)], "Date string, Wh double")
    m = al.coalesce_pairs(al.merge_by_date(a, b))
    assert {(r.Date, r.Wh, r.n) for r in m.collect()} == {("2024-01-01", 1.0, 5), ("2024-01-02", 7.0, None), (None, 2.0, 6)}
    o = al.dates_first(m)
    assert o.columns[:2] == ["Date", "LocalTime"] and {r.LocalTime for r in o.collect()} == {"2024-01-01", "2024-01-02", None}
    j = al.left_join_days(a.withColumnRenamed("Date", "LocalTime"), b, "LocalTime", "Date")
    assert j.columns == ["LocalTime", "Wh", "n", "Wh_ext"] and j.count() == 2


def test_month_day_fallback(spark):
    s = days(spark, [(D("2020-02-29"), 4.0), (D("2021-03-01"), 1.0), (D("2022-03-01"), 3.0), (D("2022-03-02"), 8.0)])
    t = spark.createDataFrame([(D(x),) for x in ("2022-03-01", "2023-03-01", "2024-02-29", "2023-12-25")], "ds date")
    got = {str(r.ds): r.y for r in al.align_month_day(s, t, "ds", "y").collect()}
    assert got == {"2022-03-01": 3.0, "2023-03-01": 2.0, "2024-02-29": 4.0, "2023-12-25": None}


def test_typical_year_shifts_zone_and_leap_day(spark):
    ty = spark.createDataFrame([(H("2007-02-28T18:00"), 1.0), (H("2009-03-01T00:00"), 2.0)], "t timestamp_ntz, `G(h)` double")
    t = spark.createDataFrame([(H(x),) for x in ("2024-03-01T08:00", "2024-03-01T02:00", "2023-03-01T02:00", "2024-02-29T02:00", "2024-05-01T00:00")], "ts timestamp_ntz")
    got = {str(r.ts): r.tmy_G for r in al.align_typical_year(t, ty, "ts", "t", ["G(h)"]).collect()}
    # 2024-03-01 02:00 local is 29 February 18:00 UTC, which takes the 28th
    assert got == {"2024-03-01 08:00:00": 2.0, "2024-03-01 02:00:00": 1.0, "2023-03-01 02:00:00": 1.0, "2024-02-29 02:00:00": 1.0, "2024-05-01 00:00:00": None}
    exact = ty.union(spark.createDataFrame([(H("2008-02-29T18:00"), 5.0)], ty.schema))
    assert {str(r.ts): r.tmy_G for r in al.align_typical_year(t, exact, "ts", "t", ["G(h)"]).collect()}["2024-03-01 02:00:00"] == 5.0
    assert al.typical_name("Gb(n) W/m2") == "tmy_GbW_m2"


def test_merge_regressors_left_wins(spark):
    t = spark.createDataFrame([(D(f"2024-01-0{i}"),) for i in (1, 2, 3)], "ds date")
    a = spark.createDataFrame([(D("2024-01-02"), 1.0)], "ds date, x double")
    b = spark.createDataFrame([(D("2024-01-01"), 9.0, "3"), (D("2024-01-03"), 9.0, "oops")], "ds date, x double, z string")
    got = al.merge_regressors(t, [a, b], "ds").orderBy("ds").collect()
    assert [(r.x, r.z) for r in got] == [(1.0, 3.0)] * 3
    assert al.common_columns(a, b, ["ds"]) == ["x"]


@pytest.mark.parametrize("known,missing,want", [
    (list(range(35)), 3, None), (list(range(10)), 2, [9.0, 9.0]), ([], 2, [0.0, 0.0])])
def test_trailing_mean_fill(spark, known, missing, want):
    ys = [float(k) for k in known] + [None] * missing
    d = days(spark, [(D("2024-01-01") + dt.timedelta(days=i), y) for i, y in enumerate(ys)])
    got = [r.y for r in fe.fill_trailing_mean(d, "y", "ds").orderBy("ds").collect()]
    seq = [float(k) for k in known]
    for _ in range(missing):
        seq.append(float(np.mean(seq[-30:])) if len(seq) >= 30 else seq[-1] if seq else 0.0)
    assert got == pytest.approx(seq) and (want is None or got[-missing:] == want)


def test_trailing_mean_fill_from_a_start(spark):
    d = days(spark, [(D("2024-01-01"), 1.0), (D("2024-01-02"), None), (D("2024-01-03"), 3.0), (D("2024-01-04"), None)])
    got = fe.fill_trailing_mean(d, "y", "ds", only=F.col("ds") >= "2024-01-03", out="z").orderBy("ds").collect()
    assert [r.z for r in got] == [1.0, None, 3.0, 3.0] and [r.y for r in got] == [1.0, None, 3.0, None]


def test_fill_directions(spark):
    d = days(spark, [(D(f"2024-01-0{i}"), y) for i, y in ((1, None), (2, 1.0), (3, None), (4, 5.0), (5, None))])
    run = lambda *a, **k: [r.y for r in fe.fill(d, ["y"], "ds", *a, **k).orderBy("ds").collect()]
    assert run() == [1, 1, 1, 5, 5] and run((), "bfill") == [1, 1, 5, 5, 5] and run((), "zero") == [0, 1, 0, 5, 0]
    assert run((), "ffill", both=False) == [None, 1, 1, 5, 5]
    twice = fe.fill(fe.fill(d, ["y"], "ds"), ["y"], "ds")
    assert [r.y for r in twice.orderBy("ds").collect()] == run()


def test_features_against_pandas(spark):
    rng = np.random.default_rng(1)
    y = pd.Series(rng.normal(size=60), index=pd.date_range("2024-01-01", periods=60))
    d = days(spark, [(t.date(), float(v)) for t, v in y.items()]).withColumn("r", F.col("y") * 2)
    got = fe.model_features(d, "y", ["r"], "ds", lag365=True).orderBy("ds").toPandas()
    assert np.allclose(got["y_lag7"], y.shift(7), equal_nan=True) and got["y_lag365"].isna().all()
    assert np.allclose(got["y_roll_mean_14"], y.shift(1).rolling(14, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got["y_roll_std_7"], y.shift(1).rolling(7, min_periods=1).std().fillna(0))
    assert np.allclose(got["r_roll7"], (2 * y).shift(1).rolling(7, min_periods=1).mean(), equal_nan=True)
    assert list(got["dayofweek"]) == list(y.index.dayofweek)


def test_weights_with_constants_and_gaps(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, 5.9, 5.0, None), (4.0, 8.0, 5.0, None)], "t double, a double, c double, n double")
    w = {r["column"]: r for r in fe.feature_weights(d, "t", ["a", "c", "n"]).collect()}
    assert w["a"].corr == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4.1, 5.9, 8])[0, 1]) and w["a"].weight == pytest.approx(1)
    assert w["c"].corr == 0 and w["n"].corr == 0
    none = fe.feature_weights(d, "t", ["c", "n"]).collect()
    assert all(r.weight == 0 for r in none)


def test_holdout_needs_a_longer_series(spark):
    d = days(spark, [("a", D(f"2024-01-0{i}"), float(i)) for i in range(1, 6)] + [("b", D("2024-01-01"), 1.0), ("b", D("2024-01-02"), 1.0)], key=True)
    train, test = fe.holdout(d, "ds", 2, ["s"])
    assert {(r.s, r.ds.day) for r in test.collect()} == {("a", 4), ("a", 5)} and {r.s for r in train.collect()} == {"a"}


def test_map_range_and_zero_range(spark):
    p = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "P double")
    ref = spark.createDataFrame([(10.0,), (30.0,)], "Wh double")
    got = sc.map_range(p, "P", ref, "Wh").orderBy("P").collect()
    assert [r.P_mapped for r in got] == [10.0, 20.0, 30.0] and got[0].P_normalised == (1 - 10) / 20
    with pytest.raises(Exception, match="range of zero"):
        sc.map_range(p, "P", spark.createDataFrame([(1.0,)], "Wh double"), "Wh").collect()


def test_ref_stats_and_minmax(spark):
    s = sc.ref_stats(spark.createDataFrame([("1.5",), ("2.5",), ("x",), (None,)], "Wh string")).first()
    assert (s.unit_detected, s.min_wh, s.max_wh, s.max_kwh, s["count"]) == ("kwh", 1500.0, 2500.0, 2.5, 2)
    st = sc.stats_from_json(spark, sc.stats_to_json(sc.ref_stats(spark.createDataFrame([(1000.0,), (3000.0,)], "Wh double"))))
    d = spark.createDataFrame([(2000.0, 4.0, 100.0, 20), (500.0, 1.0, 50.0, None)], "P_Wh double, P_kWh double, P_mean double, n_obs_P int")
    got = sc.minmax_by_ref(d, ["P_Wh", "P_kWh", "P_mean"], st, suffix="_s").orderBy("P_Wh").collect()
    assert [got[1].P_Wh_s, got[1].P_kWh_s, got[1].P_mean_s] == [0.5, 1.5, 0.5] and got[0].P_mean_s == -0.5
    clipped = sc.minmax_by_ref(d, ["P_kWh"], st, clip=True, suffix="_s").orderBy("P_Wh").collect()
    assert [r.P_kWh_s for r in clipped] == [0.0, 1.0]
    flat = sc.minmax_by_ref(d.drop("n_obs_P"), ["P_mean"], sc.ref_stats(spark.createDataFrame([(2000.0,)], "Wh double")), suffix="_s")
    assert [r.P_mean_s for r in flat.orderBy("P_Wh").collect()] == [50 * 24 - 2000.0, 100 * 24 - 2000.0]


def test_project_year_spills_into_a_further_day(spark):
    t = spark.createDataFrame([(H("2012-12-31T20:00"),), (H("2012-02-29T00:00"),), (H("2012-07-01T00:00"),)], "t timestamp_ntz")
    years = F.create_map(F.lit(1), F.lit(2007), F.lit(12), F.lit(2012))
    assert {str(r.local_time) for r in sc.project_year(t, "t", years).collect()} == {"2008-01-01 04:00:00", "2007-07-01 08:00:00"}


@pytest.mark.parametrize("name", [n for n in sc.TRANSFORMS if n != "clip_outliers"])
def test_inverse_undoes_the_transform(spark, name):
    rng = np.random.default_rng(2)
    d = days(spark, [(s, D("2024-01-01") + dt.timedelta(days=i), float(v)) for s in "ab" for i, v in enumerate(rng.normal(5, 2, 40))], key=True)
    z = sc.transform(d, name, "y", "ds", ["s"], out="z")
    back = sc.inverse(z, name, "z", sc.series_stats(d, "y", "ds", ["s"]), "ds", ["s"], out="back", first="y")
    assert all(abs(r.back - r.y) < 1e-9 for r in back.collect())


def test_clip_outliers(spark):
    d = days(spark, [(D("2024-01-01") + dt.timedelta(days=i), 100.0 if i == 20 else float(i % 3)) for i in range(40)])
    ys = np.array([100.0 if i == 20 else i % 3 for i in range(40)])
    top = max(r.c for r in sc.transform(d, "clip_outliers", "y", "ds", out="c").collect())
    assert top == pytest.approx(ys.mean() + 3 * ys.std(ddof=1))


def test_trailing_mean_over_a_century(spark):
    """36,525 days, half of them missing: as a plain loop, in time that grows with the days alone."""
    import random
    import time
    from collections import deque
    from heliochron.operators.features import fill_trailing_mean
    rng = random.Random(2)
    y = [None if rng.random() < 0.5 else rng.random() for _ in range(36_525)]
    want, last = [], deque(maxlen=30)
    for v in y:
        if v is None:
            v = sum(last) / 30 if len(last) == 30 else last[-1] if last else 0.0
        last.append(v)
        want.append(v)

    def run(n):
        d = spark.createDataFrame(list(enumerate(y[:n])), "t long, y double")
        t = time.time()
        got = [r.y for r in fill_trailing_mean(d, "y", "t").orderBy("t").collect()]
        return got, time.time() - t
    run(100)
    part, few = run(9_000)
    got, many = run(len(y))
    assert got == pytest.approx(want) and part == pytest.approx(want[:9_000])
    assert many < 8 * few + 4, (few, many)


def test_typical_year_names(spark):
    from pyspark.sql import functions as F
    from heliochron.plans.irradiance_days import typical_year_days
    rows = [("2005-01-01 %02d:00:00" % h, "x" if h == 3 else str(float(h)), "5", "0") for h in range(16)]
    d = spark.createDataFrame(rows, "t string, P string, T2m string, Int string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = typical_year_days(d, "t", tz="UTC")
    assert "Int" not in out.columns and {"P_Wh", "P_kWh", "P_mean_W", "P_p10_W", "T2m_mean", "n_obs_P", "valid_frac_P"} <= set(out.columns)
    r = out.first()
    assert r.P_Wh == sum(range(16)) - 3 and r.n_obs_P == 15 and r.P_max_W == 15 and r.T2m_p90 == 5


def test_scaling_brings_the_sisters_along(spark):
    from heliochron.operators import scaling as sc
    d = spark.createDataFrame([(10.0, 0.01, 2.0, 5)], "P_Wh double, P_kWh double, P_mean double, n_obs_P int")
    stats = sc.stats_from_json(spark, '{"unit_detected": "wh", "min_wh": 0.0, "max_wh": 20.0, "min_kwh": 0.0, "max_kwh": 0.02, "count": 2}')
    r = sc.minmax_by_ref(d, ["P_Wh"], stats).first()
    assert (r.P_Wh_minmax_by_solar, r.P_kWh_minmax_by_solar, r.P_mean_minmax_by_solar) == (0.5, 0.5, 0.5)
