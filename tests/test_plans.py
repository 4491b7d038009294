import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliochron.forecast.baselines import baseline
from heliochron.plans.forecast_scores import physical_vs_naive, score_files
from heliochron.plans.irradiance_days import irradiance_days
from heliochron.plans.energy_days import with_weather
from heliochron.plans.year_ahead import beside_naive, fill_forecast, year_ahead

DAY = lambda i: dt.date(2023, 1, 1) + dt.timedelta(days=i)


def days(spark, ys, name="y"):
    return spark.createDataFrame([(DAY(i), None if y is None else float(y)) for i, y in enumerate(ys)], f"ds date, {name} double")


def test_fill_forecast_and_totals(spark):
    h = days(spark, range(40))
    part = spark.createDataFrame([(DAY(40), 100.0), (DAY(42), -5.0)], "ds date, yhat double")
    got = [r.yhat for r in fill_forecast(h, part, 4).orderBy("lead").collect()]
    seq = [float(v) for v in range(40)] + [100.0]
    seq.append(np.mean(seq[-30:]))
    seq.append(-5.0)
    seq.append(np.mean(seq[-30:]))
    assert got == pytest.approx(seq[-4:])
    holes = days(spark, [None if i % 2 else i for i in range(10)])   # gaps in the history stay gaps
    assert [r.yhat for r in fill_forecast(holes, part.where("false"), 1).collect()] == [8.0]
    f, total = year_ahead(h, lambda hist, n: baseline(hist, "last", n).withColumn("yhat", F.col("yhat") - 50), 10, 4)
    t = total.first()
    # 39-50 is negative in every chunk; the next chunk starts from it, nothing below zero is kept
    assert t.days_counted == 10 and t.total_wh == 0 and t.forecast_start == DAY(40) and t.forecast_end == DAY(49)


def test_beside_naive(spark):
    f = spark.createDataFrame([(DAY(i), 9.0) for i in (3, 4, 5)], "ds date, yhat double")
    got = beside_naive(f, days(spark, [1, None, 2, None, 7])).orderBy("ds").collect()
    assert [(r.y, r.naive) for r in got] == [(None, 2.0), (7.0, 2.0), (None, 7.0)]


def test_physical_vs_naive(spark):
    d = days(spark, [1, 2, 4, 8])
    p = days(spark, [1, 2, 5, 8], "P_mapped_Wh")
    got = {r.model: r for r in physical_vs_naive(d, p, 2).collect()}
    assert got["physical"].mae == 0.5 and got["naive_lag1"].mae == 3 and got["physical"].mase_lag1 == 0.5


def test_score_files(spark, tmp_path):
    def put(name, text):
        os.makedirs(os.path.dirname(str(tmp_path / name)), exist_ok=True)
        (tmp_path / name).write_text(text)
    put("truth.csv", "LocalTime,Wh\n2024-01-01,1\n2024-01-02,3\n2024-01-03,\n2024-01-04,6\n")
    put("runs/1/forecast_30d.csv", ",Wh\n2024-01-03,4\n2024-01-04,6\n2024-01-05,9\n")
    r = score_files(spark, str(tmp_path / "truth.csv"), str(tmp_path / "runs"), "forecast_30d.csv").first()
    assert (r.n, r.mae, r.mase_lag1) == (2, 0.5, 0.25)
    assert score_files(spark, str(tmp_path / "truth.csv"), str(tmp_path / "runs"), "forecast_60d.csv") is None


def test_irradiance_days(spark):
    t0 = dt.datetime(2005, 1, 1)
    rows = [(t0 + dt.timedelta(hours=i), float(i % 24), float(i % 24) * 2, 10.0 + i % 5, float(i * 40 % 360), 1.0 + i % 3) for i in range(48)]
    d = spark.createDataFrame(rows, "time_utc timestamp_ntz, P double, `G(i)` double, T2m double, WD10m double, WS10m double")
    got = irradiance_days(d).orderBy("date").toPandas()
    pdf = d.toPandas().set_index("time_utc").shift(freq="8h")
    assert [str(x) for x in got["date"]] == ["2005-01-01", "2005-01-02", "2005-01-03"]
    g = pdf.resample("D")
    for c in ("P", "G(i)", "T2m"):
        assert np.allclose(got[f"{c}_mean"], g[c].mean()) and np.allclose(got[f"{c}_p10"], g[c].quantile(0.1))
        assert np.allclose(got[f"{c}_std"], g[c].std()) and list(got[f"n_obs_{c}"]) == list(g[c].count())
    assert np.allclose(got["P"], g["P"].sum()) and np.allclose(got["P_kWh"] * 1000, got["P"]) and np.allclose(got["G(i)_kWhm2"] * 1000, got["G(i)_Whm2"])
    rad = np.deg2rad(pdf["WD10m"])
    x = (pdf["WS10m"] * np.cos(rad)).resample("D").sum()
    y = (pdf["WS10m"] * np.sin(rad)).resample("D").sum()
    assert np.allclose(got["WD10m_circmean"], np.rad2deg(np.arctan2(y, x)) % 360)
    assert list(got["doy"]) == [1, 2, 3] and set(got["WD10m_mode_sector"]) <= {"N", "NE", "E", "SE", "S", "SW", "W", "NW"}


def test_with_weather(spark):
    e = spark.createDataFrame([(DAY(0), 1.0), (DAY(1), 2.0)], "LocalTime date, Wh double")
    w = spark.createDataFrame([(DAY(1), 30.0)], "Date date, Temperature double")
    got = with_weather(e, w).orderBy("LocalTime").collect()
    assert got[0].Temperature is None and got[1].Temperature == 30.0 and got[1].sin_DOY_k1 == pytest.approx(np.sin(2 * np.pi * 2 / 365))
    assert "Date" not in got[0].asDict()
