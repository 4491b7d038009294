import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliochron.forecast import backtest as bt
from heliochron.forecast.baselines import baseline
from heliochron.forecast.regress import LinearForecaster, TreeForecaster, datepart_features, fit_predict_datepart, fit_predict_window, solve_moments
from heliochron.forecast.smoothing import fit_smoothing, forecast_smoothing
from heliochron.plans.forecast_scores import backtest_days

DAY = lambda i: dt.date(2023, 1, 1) + dt.timedelta(days=i)


def series(spark, **ys):
    return spark.createDataFrame([(s, DAY(i), None if y is None else float(y)) for s, v in ys.items() for i, y in enumerate(v)],
                                 "s string, ds date, y double")


def test_baselines(spark):
    d = series(spark, a=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10], b=[5, None])
    get = lambda name, **k: {(r.s, r.lead): (r.ds, r.yhat) for r in baseline(d, name, 9, by=["s"], **k).collect()}
    last, mean, lag = get("last"), get("mean"), get("seasonal")
    assert last["a", 1] == (DAY(10), 10.0) and last["b", 9] == (DAY(10), 5.0) and mean["a", 3][1] == 5.5
    assert [lag["a", k][1] for k in range(1, 10)] == [4, 5, 6, 7, 8, 9, 10, 4, 5] and lag["b", 1][1] is None
    with pytest.raises(ValueError):
        baseline(d, "other", 3)


def packed(x, y):
    m = np.c_[x, y]
    return np.r_[len(x), m.mean(axis=0), np.cov(m.T, bias=True)[np.triu_indices(m.shape[1])]][None, :]


def test_gram_solutions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * [1, 10, 0.1, 1]
    x[:, 3] = 2.0                                            # does not vary
    y = 3 + x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200) * 0.1
    g = packed(x, y)
    ols = np.linalg.lstsq(np.c_[np.ones(200), x[:, :3]], y, rcond=None)[0]
    assert np.allclose(solve_moments(g, "none", 0)[0], np.r_[ols, 0], atol=1e-6)
    # ridge on scaled columns, checked by its normal equations
    s = x[:, :3].std(axis=0)
    z, r = (x[:, :3] - x[:, :3].mean(axis=0)) / s, y - y.mean()
    b = np.linalg.solve(z.T @ z / 200 + 0.3 * np.eye(3), z.T @ r / 200)
    assert np.allclose(solve_moments(g, "ridge", 0.3)[0, 1:4], b / s, atol=1e-6)
    # lasso meets its optimality conditions
    c = solve_moments(g, "lasso", 0.5)[0, 1:4] * s
    grad = z.T @ (r - z @ c) / 200
    assert all(abs(v) <= 0.5 + 1e-6 if w == 0 else abs(v - 0.5 * np.sign(w)) < 1e-6 for v, w in zip(grad, c))
    assert c[2] == 0 and np.allclose(solve_moments(g, "elasticnet", 0.0)[0], np.r_[ols, 0], atol=1e-5)


def test_descent_that_has_not_settled_is_missing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 3)) + rng.normal(size=(100, 1)) * 5
    g = packed(x, x.sum(axis=1))
    assert np.isnan(solve_moments(g, "lasso", 1e-4, sweeps=1)).all() and np.isfinite(solve_moments(g, "lasso", 1e-4)).all()


def test_large_offsets_and_empty_trains(spark):
    for offset in (1e6, 1e9, 1e11):
        d = spark.range(100).select((F.col("id") + F.lit(offset)).alias("x"), (2.0 * (F.col("id") + F.lit(offset)) + 1).alias("y"))
        assert abs(LinearForecaster().fit(d, ["x"], "y", []).first().coef[1] - 2) < 1e-6
    none = LinearForecaster().fit(d.where("false"), ["x"], "y", [])
    assert none.first().coef is None
    assert LinearForecaster.predict(none, d.limit(1), ["x"], []).first().yhat is None


def test_trees_keep_rows_with_missing_features(spark):
    d = spark.range(60).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 30, 1.0).otherwise(5.0).alias("y"))
    m = TreeForecaster("rf", numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False, maxBins=64).fit(d, ["x"], "y", [])
    got = m.predict(spark.createDataFrame([(1.0,), (None,), (55.0,)], "x double")).collect()
    assert sorted((r.x is None, r.x, r.yhat) for r in got if r.x is not None) == [(False, 1.0, 1.0), (False, 55.0, 5.0)]
    assert [r.yhat for r in got if r.x is None] == [None]


def test_datepart_regression_finds_the_wave(spark):
    wave = lambda i, k: 10 + k + 3 * np.sin(2 * np.pi * (DAY(i).timetuple().tm_yday) / 365.25) + (2 if DAY(i).weekday() == 5 else 0)
    d = series(spark, a=[wave(i, 0) for i in range(800)], b=[wave(i, 50) for i in range(800)])
    cut = F.col("ds") < F.lit(DAY(740))
    p = fit_predict_datepart(d.where(cut), d.where(~cut), "y", "ds", ["s"])
    assert p.count() == 120 and all(abs(r.y - r.yhat) < 1e-6 for r in p.collect())
    one = fit_predict_datepart(d.where(cut & (F.col("s") == "a")), d.where(~cut & (F.col("s") == "a")), "y", "ds", [])
    assert all(abs(r.y - r.yhat) < 1e-6 for r in one.collect())


def test_fit_equals_numpy_per_series(spark):
    rng = np.random.default_rng(5)
    d = series(spark, a=rng.normal(size=90), b=rng.normal(size=70))
    xs = datepart_features("ds", (1,))
    t = d.select("s", "ds", "y", *[c.alias(n) for n, c in xs.items()])
    coef = {r.s: r.coef for r in LinearForecaster().fit(t, list(xs), "y", ["s"]).collect()}
    for s, g in t.toPandas().groupby("s"):
        m = np.c_[np.ones(len(g)), g[list(xs)].to_numpy()]
        fitted = m @ np.linalg.lstsq(m, g["y"].to_numpy(), rcond=None)[0]
        assert np.allclose(m @ np.array(coef[s]), fitted, atol=1e-5)


def test_window_regression_uses_only_old_values(spark):
    rng = np.random.default_rng(3)
    y = [10 + (i % 7) + 0.01 * rng.normal() for i in range(200)]
    d = series(spark, a=y)
    cut = F.col("ds") < F.lit(DAY(186))
    p = {r.ds: r.yhat for r in fit_predict_window(d, cut, "y", "ds", ["s"], 14).collect()}
    hidden = series(spark, a=y[:186] + [None] * 14)
    q = {r.ds: r.yhat for r in fit_predict_window(hidden, cut, "y", "ds", ["s"], 14).collect()}
    assert len(p) == 14 and all(p[k] == pytest.approx(q[k]) for k in p)
    assert max(abs(p[DAY(i)] - y[i]) for i in range(186, 200)) < 0.5


def test_trees(spark):
    d = series(spark, a=[i % 7 for i in range(140)], b=[50 + i % 7 for i in range(140)]).withColumn("dow", F.weekday("ds").cast("double"))
    cut = F.col("ds") < F.lit(DAY(126))
    for kind, params in (("rf", {"numTrees": 5, "maxDepth": 6, "featureSubsetStrategy": "all"}), ("gbt", {"maxIter": 5, "maxDepth": 4})):
        m = TreeForecaster(kind, **params).fit(d.where(cut), ["dow"], "y", ["s"])
        p = m.predict(d.where(~cut)).collect()
        assert len(p) == 28 and np.mean([abs(r.y - r.yhat) for r in p]) < 2


def test_smoothing(spark):
    rng = np.random.default_rng(4)
    ys = {"a": list(rng.normal(10, 3, 50)), "b": list(np.cumsum(rng.normal(size=40))), "c": [4.0]}
    d = series(spark, **ys)
    alphas = (0.1, 0.5, 0.9)
    got = {r.s: r for r in fit_smoothing(d, "y", "ds", ["s"], alphas).collect()}

    def run(y, a):
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level += a * (v - level)
        return sse, a, level
    for s, y in ys.items():
        sse, a, level = min(run(y, a) for a in alphas)
        assert (got[s].alpha, got[s].sse, got[s].level, got[s].n) == (a, pytest.approx(sse), pytest.approx(level), len(y))
    flat = {(r.s, r.lead): r.yhat for r in forecast_smoothing(d, 3, by=["s"], alphas=alphas).collect()}
    theta = {(r.s, r.lead): r.yhat for r in forecast_smoothing(d, 3, by=["s"], alphas=alphas, theta=True).collect()}
    for s in ("a", "b"):
        y, a = ys[s], got[s].alpha
        slope = np.polyfit(range(len(y)), y, 1)[0]
        for k in (1, 3):
            assert flat[s, k] == pytest.approx(got[s].level)
            assert theta[s, k] == pytest.approx(got[s].level + slope / 2 * (k - 1 + 1 / a - (1 - a) ** len(y) / a))


def test_folds_and_horizons(spark):
    d = series(spark, a=range(10), b=range(4))
    f = bt.folds(d, "ds", 2, 3, ["s"]).collect()
    test = sorted((r.s, r.fold, r.y) for r in f if r.role == "test")
    assert test == [("a", 1, 8), ("a", 1, 9), ("a", 2, 6), ("a", 2, 7), ("a", 3, 4), ("a", 3, 5), ("b", 1, 2), ("b", 1, 3)]
    assert max(r.y for r in f if r.role == "train" and r.s == "a" and r.fold == 2) == 5
    h = bt.horizons(d, "ds", (3, 5), ["s"]).collect()
    assert {(r.s, r.horizon) for r in h} == {("a", 3), ("a", 5), ("b", 3)}
    assert sorted(r.y for r in h if r.role == "test" and r.s == "a" and r.horizon == 3) == [7, 8, 9]


def test_grouping_after_a_union_of_models(spark):
    """Models of a series must meet in one group, whatever the plan infers about the union."""
    d = series(spark, **{s: range(40) for s in "abcdefgh"})
    models = {m: (lambda m: lambda t, keys: baseline(t, m, 5, by=keys))(m) for m in ("last", "mean", "seasonal")}
    pred, score = backtest_days(d, models, "y", "ds", 5, 2, ["s"])
    rank = bt.rank_models(score, ["s"], "mae").collect()
    assert sorted({(r.s, r["rank"]) for r in rank}) == sorted((s, k) for s in "abcdefgh" for k in (1, 2, 3))
    best = bt.ensemble_best(pred, bt.rank_models(score, ["s"], "mae"), ["s"])
    assert best.groupBy("s").agg(F.countDistinct("model").alias("n")).where("n <> 1").count() == 0
    mean = {(r.s, r.fold, r.ds): r.yhat for r in bt.ensemble_mean(pred, ["s", "fold"], "ds").collect()}
    parts = {}
    for r in pred.collect():
        parts.setdefault((r.s, r.fold, r.ds), []).append(r.yhat)
    assert all(mean[k] == pytest.approx(np.mean(v)) and len(v) == 3 for k, v in parts.items())


def test_chunks_match_the_loop_they_stand_for(spark):
    d = series(spark, a=range(50), b=range(7))

    def model(hist, n):                                       # says nothing for every third day
        p = baseline(hist, "last", n, by=["s"])
        return p.where(F.pmod("lead", F.lit(3)) != 0)
    got = {(r.s, r.lead): (r.ds, r.yhat) for r in bt.forecast_in_chunks(d, model, 10, 4, by=["s"]).collect()}
    for s, n in (("a", 50), ("b", 7)):
        hist, want = [float(v) for v in range(n)], []
        while len(want) < 10:
            k = min(4, 10 - len(want))
            back = np.mean(hist[-30:]) if len(hist) >= 30 else hist[-1]
            new = [back if (i + 1) % 3 == 0 else hist[-1] for i in range(k)]
            want += new
            hist += new
        assert [got[s, i + 1][1] for i in range(10)] == pytest.approx(want) and got[s, 10][0] == DAY(n + 9)


def test_a_series_that_cannot_be_fitted_falls_back(spark):
    def model(hist, n):
        p = baseline(hist, "last", n, by=["s"])
        return p.withColumn("yhat", F.when(F.col("s") != "b", F.col("yhat")))
    got = {(r.s, r.lead): r.yhat for r in bt.forecast_in_chunks(series(spark, a=range(40), b=range(40)), model, 3, 2, by=["s"]).collect()}
    assert got["b", 1] == np.mean(range(10, 40)) and got["a", 1] == 39 and len(got) == 6

    def broken(hist, n):
        raise RuntimeError("the job itself")
    with pytest.raises(RuntimeError):
        bt.forecast_in_chunks(series(spark, a=range(40)), broken, 3, 2, by=["s"])


def test_fallback_interval_and_regressors(spark):
    a = series(spark, a=[1, None, None]).withColumnRenamed("y", "yhat")
    b = series(spark, a=[9, 2, None]).withColumnRenamed("y", "yhat")
    c = series(spark, a=[9, 9, 3]).withColumnRenamed("y", "yhat")
    assert [r.yhat for r in bt.with_fallback(a, b, c, keys=["s", "ds"]).orderBy("ds").collect()] == [1, 2, 3]
    res = spark.createDataFrame([("a", 1, float(e), 0.0) for e in range(11)], "s string, lead int, y double, yhat double")
    f = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 100.0)], "s string, lead int, yhat double")
    r = bt.interval(f, res, ["s"]).orderBy("lead").collect()
    assert (r[0].lower, r[0].upper) == (100.5, 109.5) and r[1].lower is None
    reg = spark.createDataFrame([(DAY(1), "1", 5.0, None), (DAY(3), "x", 6.0, None)], "ds date, v string, Wh double, e double")
    dates = spark.createDataFrame([(DAY(i),) for i in range(5)], "ds date")
    p = bt.prepare_regressors(reg, dates, "ds")
    assert p.columns == ["ds", "v"] and [x.v for x in p.collect()] == [1.0] * 5


def test_moments_equal_the_copied_grid(spark):
    """Baselines from moments against the same models given every train row, on folds and on horizons."""
    rng = np.random.default_rng(4)
    a = [float(v) for v in rng.normal(10, 3, 90)]
    a[40] = a[80] = None
    d = series(spark, a=a, b=[5.0] * 70, c=range(25), short=range(9)).cache()
    models = {n: (lambda train, keys, n=n: baseline(train, n, 40, by=keys)) for n in ("last", "mean", "seasonal")}
    for key, cells, grid in (("fold", bt.fold_cells(10, 3), bt.folds(d, "ds", 10, 3, ["s"])), ("horizon", bt.horizon_cells((40, 20, 8)), bt.horizons(d, "ds", (40, 20, 8), ["s"]))):
        pred, score = bt.backtest_baselines(d, list(models), "y", "ds", cells, ["s"], key)
        want = bt.backtest(grid, models, "y", "ds", ["s"], [key])
        rows = lambda t: {(r.s, r[key], r.model, r.ds): (r.lead, r.y, None if r.yhat is None else round(r.yhat, 9)) for r in t.collect()}
        assert rows(pred) == rows(want) and len(rows(pred)) > 100
        one = {(r.s, r[key], r.model): r for r in score.collect()}
        two = {(r.s, r[key], r.model): r for r in bt.backtest_scores(grid, want, "y", "ds", ["s"], [key]).collect()}
        assert set(one) == set(two)
        for k, r in one.items():
            for c in ("n", "mae", "mase_lag1", "rmse", "rmsse", "smape", "r2"):
                assert (r[c] is None) == (two[k][c] is None) and (r[c] is None or r[c] == pytest.approx(two[k][c])), (k, c)
    with pytest.raises(ValueError):
        bt.backtest_baselines(d, ["clock_hour"], "y", "ds", cells, ["s"])


def test_no_train_row_is_copied(spark):
    d = series(spark, a=range(400))
    p = bt.train_moments(d, "y", "ds", bt.fold_cells(30, 3), ["s"])._jdf.queryExecution().optimizedPlan().toString()
    below = p[p.index("Aggregate", p.index("Generate explode")):]  # what the exploded blocks come from
    assert "Generate" not in below and "avg(" in below


def test_bad_variables_are_named_and_the_others_go_on(spark):
    from heliochron.forecast.regress import forecast_every
    rng = np.random.default_rng(6)
    d = series(spark, good=rng.normal(size=60), few=[1, 2, 3], flat=[4.0] * 60, none=[None] * 30)
    got = {}
    for r in forecast_every(d, 5, by=["s"]).collect():
        got.setdefault(r.s, []).append(r)
    assert {s: {r.status for r in v} for s, v in got.items()} == {"good": {"ok"}, "few": {"too_short"}, "flat": {"no_variation"}, "none": {"no_rows"}}
    assert all(len(v) == 5 for v in got.values()) and {r.lead for r in got["few"]} == {1, 2, 3, 4, 5}
    assert all(r.yhat is None for s in ("few", "none") for r in got[s]) and all(r.yhat == pytest.approx(4.0) for r in got["flat"])
    still = LinearForecaster("lasso", 1e-4)
    x = d.where("s = 'good'").select("s", "y", F.rand(1).alias("x1"), F.rand(2).alias("x2"))
    assert still.fit(x, ["x1", "x2"], "y", ["s"]).first().status == "ok"
    assert LinearForecaster(least=100).fit(x, ["x1"], "y", ["s"]).first().status == "too_short"


def test_pooled_intervals_cover(spark):
    """Three folds of a year: bounds from neighbouring leads hold about their share, three errors alone far less."""
    rng = np.random.default_rng(8)
    res = spark.createDataFrame([("a", lead, float(e), 0.0) for lead in range(1, 201) for e in rng.normal(size=3)], "s string, lead int, y double, yhat double")
    new = spark.createDataFrame([("a", lead, 0.0) for lead in range(1, 201)], "s string, lead int, yhat double")
    true = rng.normal(size=(200, 50))

    def share(pool):
        rows = bt.interval(new, res, ["s"], 0.9, pool=pool).collect()
        assert len(rows) == 200
        return np.mean([(true[r.lead - 1] >= r.lower) & (true[r.lead - 1] <= r.upper) for r in rows])
    assert share(0) < 0.7 and 0.85 < share(10) < 0.93
    r = bt.interval(new.limit(1), spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 5.0, 0.0), ("a", 9, 99.0, 0.0)], res.schema), ["s"], 0.5, pool=1).first()
    assert (r.lower, r.upper) == (1.0, pytest.approx(3.0))  # errors 1, 1, 5
