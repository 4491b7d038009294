import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliochron.operators import profile as pr
from heliochron.operators import score as so

DAY = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def frame(spark, ys, ps=None, start=0):
    return spark.createDataFrame([("a", DAY(start + i), y, None if ps is None else ps[i]) for i, y in enumerate(ys)],
                                 "s string, ds date, y double, yhat double")


def by_hand(y, p, train):
    y, p, t = (np.asarray(v, float) for v in (y, p, train))
    e = p - y
    nz = np.abs(y) > 1e-9
    div = lambda a, b: a / b if b else None
    d = np.diff(t)
    mae, rmse = np.abs(e).mean(), np.sqrt((e ** 2).mean())
    return {"n": len(y), "mae": mae, "mase_lag1": div(mae, np.abs(d).mean() if len(d) else 0), "rmse": rmse,
            "rmsse": div(rmse, np.sqrt((d ** 2).mean()) if len(d) else 0), "nmae": div(mae, y.mean()), "nrmse": div(rmse, y.mean()),
            "mape": np.abs(e[nz] / y[nz]).mean() * 100 if nz.any() else None,
            "smape": (2 * np.abs(e) / (np.abs(y) + np.abs(p) + 1e-9)).mean() * 100,
            "r2": 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum() if y.std() else None}


@pytest.mark.parametrize("y,p,train", [
    ([1, 2, 4], [1.5, 2, 3], [1, 3, 2]),
    ([1, 2, 4], [1, 2, 4], [1, 3, 2]),       # perfect
    ([3, 3, 3], [3, 4, 5], [1, 3, 2]),       # constant truth
    ([0, 0, 2], [0, 1, 2], [1, 3, 2]),       # zeros in the truth
    ([0, 0, 0], [0, 1, 2], [2, 2, 2]),       # nothing but zeros, flat train
    ([1, 2, 4], [1.5, 2, 3], [1]),           # one train row
])
def test_scores(spark, y, p, train):
    f = [float(v) for v in y], [float(v) for v in p]
    got = so.scores(frame(spark, *f, start=10), frame(spark, [float(v) for v in train]), by=["s"]).first()
    one = so.scores(frame(spark, *f, start=10), frame(spark, [float(v) for v in train])).first()
    for k, v in by_hand(y, p, train).items():
        for r in (got, one):
            assert (r[k] is None) if v is None else r[k] == pytest.approx(v), k


def test_pairs_with_a_hole_are_left_out(spark):
    got = so.scores(frame(spark, [1.0, None, 4.0], [2.0, 5.0, None], 10), frame(spark, [1.0, 3.0]), by=["s"]).first()
    assert got.n == 1 and got.mae == 1


def test_smape_forms(spark):
    d = frame(spark, [0.0, 0.0, 2.0], [0.0, 1.0, 2.0])
    r = d.agg(so.smape_skip(F.col("y"), F.col("yhat")).alias("a"), so.smape_fraction(F.col("y"), F.col("yhat")).alias("b")).first()
    assert r.a == pytest.approx(100.0) and r.b == pytest.approx(2 / 3)


def test_mase_seasonal_needs_more_than_the_lag(spark):
    pred = frame(spark, [1.0], [3.0], 400)
    assert so.mase_seasonal(pred, frame(spark, [1.0] * 365), by=["s"]).first().mase_lag365 is None
    longer = frame(spark, [1.0] * 365 + [5.0])
    assert so.mase_seasonal(pred, longer, by=["s"]).first().mase_lag365 == 0.5


def test_window_scores(spark):
    d = frame(spark, [1.0, 3.0, 2.0, 6.0], [None, None, 4.0, 4.0])
    r = so.scores_on_window(d, "y", "yhat", "ds", ["s"]).first()
    assert r.mae == 2 and r.mase == pytest.approx(2 / 2.5) and r.r2 == pytest.approx(1 - 8 / 8)
    flat = so.scores_on_window(frame(spark, [2.0, 2.0, 2.0], [None, 3.0, 3.0]), "y", "yhat", "ds", ["s"]).first()
    assert flat.mase is None and flat.r2 is None


def test_stored_forecast_train_rule(spark):
    truth = frame(spark, [1.0, 2.0, 4.0, 8.0]).drop("yhat")
    late = frame(spark, [0.0] * 3, [5.0, 9.0, 1.0], 2).drop("y")       # two shared days, one beyond
    r = so.score_stored(late, truth, by=["s"]).first()
    assert r.n == 2 and r.mae == 1 and r.mase_lag1 == pytest.approx(1 / 1)
    whole = frame(spark, [0.0] * 4, [1.0, 2.0, 4.0, 9.0]).drop("y")    # nothing before: all of the truth
    assert so.score_stored(whole, truth, by=["s"]).first().mase_lag1 == pytest.approx(0.25 / (7 / 3))
    assert so.score_stored(whole, truth).first().mase_lag1 == pytest.approx(0.25 / (7 / 3))


def test_numeric_profile_against_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.exponential(size=80), "k": np.where(rng.random(80) < 0.3, np.nan, rng.integers(0, 9, 80)), "c": 4.0})
    d = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    got = pr.profile_numeric(d).toPandas().set_index("variable")
    for c in ("x", "k"):
        s, r = pdf[c], got.loc[c]
        want = dict(count=80, non_null=s.count(), missing_count=s.isna().sum(), mean=s.mean(), median=s.median(), std=s.std(), min=s.min(),
                    max=s.max(), sum=s.sum(), skew=s.skew(), kurtosis=s.kurt(), **{"25%": s.quantile(.25), "75%": s.quantile(.75)})
        for k, v in want.items():
            assert r[k] == pytest.approx(v), (c, k)
    for k, v in (("skew", pdf["c"].skew()), ("kurtosis", pdf["c"].kurt()), ("std", 0.0)):
        assert got.loc["c", k] == v
    assert {r.variable: r.missing_count for r in pr.missing_counts(d).collect()} == {c: int(pdf[c].isna().sum()) for c in pdf}


def test_categorical_profile(spark):
    d = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "v string, w string")
    got = {r.variable: r for r in pr.profile_categorical(d).collect()}
    assert (got["v"].unique_count, got["v"].top, got["v"].freq) == (2, "a", 2)
    assert (got["w"].unique_count, got["w"].top, got["w"].freq) == (0, None, None)


@pytest.mark.parametrize("mins,label,med", [([0, 60, 120], "hour", None), ([0, 1440, 2880], "day", None), ([0, 5, 10, 15], "300.0s", None),
                                            ([0, 1, 2, 5], None, 60.0), ([0, 60], None, 3600.0), ([0, 0, 60], None, 1800.0), ([7], None, None)])
def test_time_profile(spark, mins, label, med):
    t0 = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m)) for m in mins] + [("a", None)], "s string, ts timestamp_ntz")
    for r in (pr.profile_time(d, "ts", ["s"], 1800).first(), pr.profile_time(d, "ts").first()):
        assert (r.inferred_freq, r.median_delta_seconds) == (label, med)
        assert r.start == t0 + dt.timedelta(minutes=mins[0]) and r.end == t0 + dt.timedelta(minutes=mins[-1])


def test_categories_by_digest(spark):
    """Long texts, short ones, ties within and between them, missing values, a text that looks like a key."""
    import hashlib
    import random
    from collections import Counter
    from heliochron.operators.profile import DIGEST, profile_categorical
    rng = random.Random(4)
    long = ["z" * 40, "a" * 33, "m" * 500, "é" * 17, DIGEST + hashlib.md5(b"z" * 40).hexdigest()]
    for pool in ([*long, "b", ""], long, ["x", "y", "a" * 32], [*long * 2, "b"], [None]):
        for draws in (1, 40):
            v = [rng.choice([*pool, None]) for _ in range(draws)] + list(dict.fromkeys(pool))
            d = spark.createDataFrame([(1, x, "k") for x in v], "g int, t string, u string")
            got = {r.variable: (r.unique_count, r.top, r.freq) for r in profile_categorical(d, ["t", "u"], ["g"]).collect()}
            n = Counter(x for x in v if x is not None)
            best = min(n.items(), key=lambda x: (-x[1], x[0].encode())) if n else (None, None)
            assert got == {"t": (len(n), *best), "u": (1, "k", len(v))}


def test_long_texts_are_not_sent_for_the_counts(spark):
    from pyspark.sql import functions as F
    from heliochron.operators.profile import profile_categorical
    d = spark.range(1000).select(F.repeat(F.col("id").cast("string"), 200).alias("t"))
    plan = profile_categorical(d)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("partial_count"):]
    assert "md5" in plan and "keys=[variable" in first
