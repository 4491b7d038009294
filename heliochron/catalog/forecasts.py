"""Forecasts (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..forecast import backtest as bt
from ..forecast.baselines import baseline
from ..forecast.regress import (LinearForecaster, TreeForecaster, datepart_features, fit_predict_datepart,
                                fit_predict_window, lag_features)
from ..forecast.smoothing import ALPHAS, forecast_smoothing
from ..operators import features as fe
from ..plans.forecast_scores import backtest_days
from .base import AOD, ED, EH, LD, ODF, all_order_days, event_days, event_hours, line_days, order_days, stored_order_days, query, r, rnd
from .elimination import datepart_future_sql, datepart_sql, window_sql
from .scoring import rounded, score_sql

BY = ["series"]


def _out(d, keys=("series",), digits=2):
    return d.select(*keys, "lead", "ds", rnd("yhat", digits).alias("yhat"))


_NEXT = "SELECT series, max(ds) AS last FROM odf GROUP BY 1"


def _ahead(h, yhat, extra=""):
    return f"""WITH {ODF}, nx AS ({_NEXT}), f AS (SELECT series, last, CAST(unnest(generate_series(1, {h})) AS INTEGER) AS lead FROM nx){extra}
SELECT f.series, f.lead, CAST(f.last + f.lead * INTERVAL 1 DAY AS DATE) AS ds, {yhat} AS yhat FROM f"""


_SEASONAL = _ahead(30, r("odf.y", 2)) + " LEFT JOIN odf ON odf.series = f.series AND odf.ds = CAST(f.last + (f.lead - CAST(ceil(f.lead / 7) AS INTEGER) * 7) * INTERVAL 1 DAY AS DATE)"


@query("g1_last_value", _ahead(30, r("g.v", 2), ", g AS (SELECT series, arg_max(y, ds) AS v FROM odf GROUP BY 1)") + " JOIN g USING (series)")
def g1_last(spark, sf):
    return _out(baseline(stored_order_days(spark, sf), "last", 30, by=BY))


@query("g1_mean", _ahead(30, r("g.v", 2), ", g AS (SELECT series, avg(y) AS v FROM odf GROUP BY 1)") + " JOIN g USING (series)")
def g1_mean(spark, sf):
    return _out(baseline(stored_order_days(spark, sf), "mean", 30, by=BY))


@query("g1_seasonal_lag", _SEASONAL)
def g1_seasonal(spark, sf):
    return _out(baseline(stored_order_days(spark, sf), "seasonal", 30, by=BY))


@query("g1_clock_hour_mean", f"""WITH {EH}, m AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM eh GROUP BY 1, 2),
f AS (SELECT event_type, max(ts) AS last, CAST(unnest(generate_series(1, 48)) AS INTEGER) AS lead FROM eh GROUP BY 1)
SELECT f.event_type, lead, last + lead * INTERVAL 1 HOUR AS ds, {r('m.v')} AS yhat FROM f LEFT JOIN m ON m.event_type = f.event_type AND m.h = hour(last + lead * INTERVAL 1 HOUR)""")
def g1_clock(spark, sf):
    h = event_hours(spark, sf).select("event_type", F.col("ts").alias("ds"), F.col("value").alias("y"))
    return _out(baseline(h, "clock_hour", 48, by=["event_type"], step="hour"), ("event_type",), 4)


def _cut(spark, sf, h=30):
    return fe.holdout(stored_order_days(spark, sf), "ds", h, BY)


_SPLIT = f"{ODF}, sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 30 AS is_test FROM odf)"


@query("g2_trend_regression", f"""WITH {_SPLIT}, m AS (SELECT series, regr_slope(y, date_diff('day', DATE '1970-01-01', ds)) AS b, regr_intercept(y, date_diff('day', DATE '1970-01-01', ds)) AS a
FROM sp WHERE NOT is_test GROUP BY 1) SELECT series, ds, {r("a + b * date_diff('day', DATE '1970-01-01', ds)", 0)} AS yhat FROM sp JOIN m USING (series) WHERE is_test""")
def g2_trend(spark, sf):
    train, test = _cut(spark, sf)
    x = [((F.unix_date("ds") - 9000) / 365.25).alias("t")]
    coef = LinearForecaster().fit(train.select("*", *x), ["t"], "y", BY)
    d = LinearForecaster.predict(coef, test.select("*", *x), ["t"], BY)
    return d.select("series", "ds", rnd("yhat", 0).alias("yhat"))


@query("g2_datepart_regression", datepart_sql(ODF, 0.0))
def g2(spark, sf):
    train, test = _cut(spark, sf)
    return fit_predict_datepart(train, test, "y", "ds", BY).select("series", "ds", rnd("yhat", 0).alias("yhat"))


def _penalty(name, alpha):
    def f(spark, sf):
        train, test = _cut(spark, sf)
        return fit_predict_datepart(train, test, "y", "ds", BY, LinearForecaster(name, alpha)).select("series", "ds", rnd("yhat", 0).alias("yhat"))
    return f


query("g2_ridge", datepart_sql(ODF, 0.1))(_penalty("ridge", 0.1))
query("g2_lasso")(_penalty("lasso", 1000.0))
query("g2_elastic_net")(_penalty("elasticnet", 100.0))


@query("g3_window_regression", window_sql(ODF, 0.001, 30, (0, 1, 6, 7, 13, 27), (7, 28)))
def g3(spark, sf):
    d = fe.mark_holdout(stored_order_days(spark, sf), "ds", 30, BY)
    p = fit_predict_window(d, ~F.col("is_test"), "y", "ds", BY, 30)
    return p.select("series", "ds", rnd("yhat", 0).alias("yhat"))


def _trees(kind, **params):
    def f(spark, sf):
        xs = {**datepart_features("ds", (1,)), **lag_features("y", "ds", BY, 30, (0, 6), (7,))}
        d = fe.mark_holdout(stored_order_days(spark, sf), "ds", 30, BY).select("*", *[c.alias(n) for n, c in xs.items()])
        m = TreeForecaster(kind, **params).fit(d.where(~F.col("is_test")), list(xs), "y", BY)
        return m.predict(d.where("is_test")).select("series", "ds", rnd("yhat", 2).alias("yhat"))
    return f


# One split on the month: the cut with the least squared error, and the mean on either side of it.
_STUMP = f"""WITH {AOD}, t AS (SELECT ds, month(ds) AS x, y FROM aod), c AS (SELECT DISTINCT x AS cut FROM t),
s AS (SELECT cut, avg(y) FILTER (x <= cut) AS l, avg(y) FILTER (x > cut) AS h, count(*) FILTER (x <= cut) AS nl, count(*) FILTER (x > cut) AS nh
FROM t, c GROUP BY cut), b AS (SELECT * FROM s WHERE nh > 0 ORDER BY nl * l * l + nh * h * h DESC LIMIT 1)
SELECT ds, {r('CASE WHEN x <= cut THEN l ELSE h END', 2)} AS yhat FROM t, b"""


def _stump(kind, **params):
    def f(spark, sf):
        d = all_order_days(spark, sf).select("ds", "y", F.month("ds").cast("double").alias("x"))
        m = TreeForecaster(kind, maxDepth=1, maxBins=64, **params).fit(d, ["x"], "y", [])
        return m.predict(d).select("ds", rnd("yhat", 2).alias("yhat"))
    return f


query("g4_forest_of_one_split", _STUMP)(_stump("rf", numTrees=1, featureSubsetStrategy="all", bootstrap=False))
query("g4_boosting_of_one_split", _STUMP)(_stump("gbt", maxIter=1, featureSubsetStrategy="all"))
query("g4_random_forest")(_trees("rf", numTrees=12, maxDepth=5))
query("g4_boosted_trees")(_trees("gbt", maxIter=6, maxDepth=4))


def _ses_sql(theta: bool) -> str:
    grid = ", ".join(str(a) for a in ALPHAS)
    yhat = "level + slope / 2 * (lead - 1 + 1 / alpha - power(1 - alpha, n) / alpha)" if theta else "level"
    return f"""WITH RECURSIVE {ODF}, n AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS i FROM odf),
f AS (SELECT series, i, a.alpha::DOUBLE AS alpha, y AS level, 0.0::DOUBLE AS sse FROM n, (SELECT unnest([{grid}]) AS alpha) a WHERE i = 1
UNION ALL SELECT f.series, n.i, f.alpha, f.level + f.alpha * (n.y - f.level), f.sse + (n.y - f.level) * (n.y - f.level) FROM f JOIN n ON n.series = f.series AND n.i = f.i + 1),
b AS (SELECT series, alpha, level, i AS n FROM f JOIN (SELECT series, max(i) AS i FROM n GROUP BY 1) USING (series, i) QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, alpha) = 1),
s AS (SELECT series, regr_slope(y, date_diff('day', DATE '1970-01-01', ds)) AS slope, max(ds) AS last FROM odf GROUP BY 1),
l AS (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS lead)
SELECT series, lead, CAST(last + lead * INTERVAL 1 DAY AS DATE) AS ds, {r(yhat, 1)} AS yhat FROM b JOIN s USING (series), l"""


@query("g5_exponential_smoothing", _ses_sql(False))
def g5(spark, sf):
    return _out(forecast_smoothing(stored_order_days(spark, sf), 30, by=BY), digits=1)


@query("g5_theta", _ses_sql(True))
def g5_theta(spark, sf):
    return _out(forecast_smoothing(stored_order_days(spark, sf), 30, by=BY, theta=True), digits=1)


@query("g6_chunked_forecast", _SEASONAL.replace("generate_series(1, 30)", "generate_series(1, 200)"))
def g6(spark, sf):
    """200 days in chunks of 90, each appended to the history before the next."""
    m = lambda hist, n: baseline(hist, "seasonal", n, by=BY)
    return _out(bt.forecast_in_chunks(stored_order_days(spark, sf), m, 200, 90, by=BY))


_HZ = f"""{ODF}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS r FROM odf),
g AS (SELECT x.*, h.horizon, CASE WHEN r <= h.horizon THEN 'test' ELSE 'train' END AS role FROM x, (SELECT CAST(unnest([120, 90, 60, 30]) AS INTEGER) AS horizon) h),
m AS (SELECT series, horizon, avg(y) AS p FROM g WHERE role = 'train' GROUP BY 1, 2),
tr AS (SELECT series, horizon, avg(abs(d)) AS dm, sqrt(avg(d * d)) AS dr FROM (SELECT series, horizon, y - lag(y) OVER (PARTITION BY series, horizon ORDER BY ds) AS d FROM g WHERE role = 'train') GROUP BY 1, 2),
s AS (SELECT series, horizon, y, p FROM g JOIN m USING (series, horizon) WHERE role = 'test')"""


@query("g7_multi_horizon", f"WITH {_HZ} {score_sql('s', 'series, horizon', 'series, horizon')}")
def g7(spark, sf):
    _, s = bt.backtest_baselines(stored_order_days(spark, sf), ["mean"], "y", "ds", bt.horizon_cells(), BY, "horizon")
    return rounded(s, ["series", "horizon"])


_BT = f"""{ODF}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) - 1 AS r FROM odf),
g AS (SELECT x.*, f.fold, CASE WHEN r < f.fold * 30 THEN 'test' ELSE 'train' END AS role FROM x, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS fold) f WHERE r >= (f.fold - 1) * 30),
m AS (SELECT series, fold, avg(y) AS mean, arg_max(y, ds) AS last FROM g WHERE role = 'train' GROUP BY 1, 2),
tr AS (SELECT series, fold, avg(abs(d)) AS dm, sqrt(avg(d * d)) AS dr FROM (SELECT series, fold, y - lag(y) OVER (PARTITION BY series, fold ORDER BY ds) AS d FROM g WHERE role = 'train') GROUP BY 1, 2),
p AS (SELECT series, fold, 'mean' AS model, 30 - (r - (fold - 1) * 30) AS lead, ds, y, mean AS p FROM g JOIN m USING (series, fold) WHERE role = 'test' UNION ALL
SELECT series, fold, 'last', 30 - (r - (fold - 1) * 30), ds, y, last FROM g JOIN m USING (series, fold) WHERE role = 'test' UNION ALL
SELECT t.series, t.fold, 'seasonal', 30 - (t.r - (t.fold - 1) * 30), t.ds, t.y, s.y FROM g t JOIN odf s ON s.series = t.series
  AND s.ds = CAST(t.ds - CAST(ceil((30 - (t.r - (t.fold - 1) * 30)) / 7) AS INTEGER) * INTERVAL 7 DAY AS DATE) WHERE t.role = 'test'),
sm AS (SELECT series, fold, model, 100 * avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-9)) AS smape FROM p GROUP BY 1, 2, 3),
sc AS (SELECT series, model, avg(smape) AS score FROM sm GROUP BY 1, 2)"""

MODELS = ("last", "mean", "seasonal")


def _backtest(spark, sf):
    return backtest_days(order_days(spark, sf), MODELS, "y", "ds", 30, 3, BY)


@query("g8_backtest_scores", f"WITH {_BT} {score_sql('p', 'series, fold, model', 'series, fold')}")
def g8(spark, sf):
    _, s = _backtest(spark, sf)
    return rounded(s, ["series", "fold", "model"])


@query("g8_backtest_predictions", f"WITH {_BT} SELECT series, fold, model, CAST(lead AS INTEGER) AS lead, ds, {r('y', 2)} AS y, {r('p', 2)} AS yhat FROM p")
def g8_pred(spark, sf):
    p, _ = _backtest(spark, sf)
    return p.select("series", "fold", "model", "lead", "ds", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


def _fz(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"""


@query("g9_prepare_regressors", f"""WITH {AOD}, {LD}, t AS (SELECT CAST(unnest(generate_series(min(ds), max(ds) + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM aod),
j AS (SELECT t.ds, qty, disc FROM t LEFT JOIN ld USING (ds)) SELECT ds, {r(_fz('qty'), 2)} AS qty, {r(_fz('disc'))} AS disc FROM j""")
def g9(spark, sf):
    from ..operators.resample import spine_between
    b = all_order_days(spark, sf).agg(F.min("ds").alias("a"), F.date_add(F.max("ds"), 60).alias("b"))
    reg = line_days(spark, sf).select("ds", "qty", "disc", F.col("price").alias("Wh"), F.lit(None).cast("double").alias("empty"))
    d = bt.prepare_regressors(reg, spine_between(b, "a", "b", "day"), "ds")
    return d.select(*["ds"], *[rnd(c, 2 if c == "qty" else 4).alias(c) for c in d.columns if c != "ds"])


@query("g10_every_variable", f"""WITH {ED}, nx AS (SELECT series, max(ds) AS last FROM ed GROUP BY 1), f AS (SELECT series, last, CAST(unnest(generate_series(1, 14)) AS INTEGER) AS lead FROM nx)
SELECT f.series, f.lead, CAST(f.last + f.lead * INTERVAL 1 DAY AS DATE) AS ds, {r('ed.y', 2)} AS yhat FROM f LEFT JOIN ed ON ed.series = f.series
AND ed.ds = CAST(f.last + (f.lead - CAST(ceil(f.lead / 7) AS INTEGER) * 7) * INTERVAL 1 DAY AS DATE)""")
def g10(spark, sf):
    """Wide table of variables to long form, all forecast in one job."""
    from ..operators.align import merge_forecasts
    wide = merge_forecasts(event_days(spark, sf), "ds", "series", "y")
    long = fe.unpivot_series(wide, ["ds"], [c for c in wide.columns if c != "ds"], "series")
    return _out(baseline(long, "seasonal", 14, by=BY))


_FEW = "SELECT series, min(ds) AS a FROM ed GROUP BY 1"


@query("g10_failures_named", f"""WITH g AS ({datepart_future_sql(ED + ", odf AS (SELECT * FROM ed)", 0.01, 14)}), {ED}, fw AS ({_FEW}),
l AS (SELECT CAST(unnest(generate_series(1, 14)) AS INTEGER) AS lead), n AS (SELECT series, max(ds) AS b FROM ed GROUP BY 1)
SELECT series, lead, ds, yhat, 'ok' AS status FROM g
UNION ALL SELECT 'few ' || series, lead, CAST(a + (2 + lead) * INTERVAL 1 DAY AS DATE), NULL, 'too_short' FROM fw, l
UNION ALL SELECT 'none ' || series, lead, CAST(b + lead * INTERVAL 1 DAY AS DATE), NULL, 'no_rows' FROM n, l""")
def g10_failures(spark, sf):
    """Every variable in one job; three days are too few for the regression, and some variables have no value at all."""
    from ..forecast.regress import forecast_every
    from ..operators.scaling import clip_zero
    from ..session import union_all
    d = event_days(spark, sf)
    first = d.groupBy("series").agg(F.date_add(F.min("ds"), 3).alias("until"))
    few = d.join(first, "series").where("ds < until").select(F.concat(F.lit("few "), "series").alias("series"), "ds", "y")
    none = d.select(F.concat(F.lit("none "), "series").alias("series"), "ds", F.lit(None).cast("double").alias("y"))
    f = forecast_every(union_all([d, few, none]).withColumn("ds", F.col("ds").cast("date")), 14, by=BY, model=LinearForecaster("ridge", 0.01, least=14))
    return f.select("series", "lead", "ds", rnd(clip_zero(F.col("yhat")), 0).alias("yhat"), "status")


@query("g11_ensemble_mean", f"WITH {_BT} SELECT series, fold, ds, {r('avg(p)', 2)} AS yhat FROM p GROUP BY 1, 2, 3")
def g11(spark, sf):
    p, _ = _backtest(spark, sf)
    return bt.ensemble_mean(p, ["series", "fold"], "ds").select("series", "fold", "ds", rnd("yhat", 2).alias("yhat"))


@query("g11_ensemble_weighted", f"WITH {_BT} SELECT series, fold, ds, {r('sum(p / score) / sum(1 / score)', 2)} AS yhat FROM p JOIN sc USING (series, model) GROUP BY 1, 2, 3")
def g11_weighted(spark, sf):
    p, s = _backtest(spark, sf)
    score = bt.rank_models(s, BY)
    w = score.where("score > 0").select("series", "model", "score")
    d = bt.ensemble_weighted(p.withColumn("cell", F.struct("fold", "ds")), w, BY, "cell")
    return d.select("series", "cell.fold", "cell.ds", rnd("yhat", 2).alias("yhat"))


@query("g11_ensemble_best", f"""WITH {_BT}, b AS (SELECT series, model FROM sc QUALIFY row_number() OVER (PARTITION BY series ORDER BY score, model) = 1)
SELECT series, model, fold, ds, {r('p', 2)} AS yhat FROM p JOIN b USING (series, model)""")
def g11_best(spark, sf):
    p, s = _backtest(spark, sf)
    d = bt.ensemble_best(p, bt.rank_models(s, BY), BY)
    return d.select("series", "model", "fold", "ds", rnd("yhat", 2).alias("yhat"))


@query("g12_prediction_interval", f"""WITH {_BT}, q AS (SELECT series, lead, quantile_cont(y - p, 0.05) AS a, quantile_cont(y - p, 0.95) AS b FROM p WHERE model = 'mean' GROUP BY 1, 2),
f AS (SELECT series, avg(y) AS yhat, max(ds) AS last FROM odf GROUP BY 1)
SELECT series, CAST(lead AS INTEGER) AS lead, CAST(last + CAST(lead AS INTEGER) * INTERVAL 1 DAY AS DATE) AS ds, {r('yhat', 2)} AS yhat, {r('yhat + a', 2)} AS lower, {r('yhat + b', 2)} AS upper FROM f JOIN q USING (series)""")
def g12(spark, sf):
    p, _ = backtest_days(order_days(spark, sf), ["mean"], "y", "ds", 30, 3, BY)
    f = baseline(stored_order_days(spark, sf), "mean", 30, by=BY)
    d = bt.interval(f, p, BY)
    return d.select("series", "lead", "ds", *[rnd(c, 2).alias(c) for c in ("yhat", "lower", "upper")])


_POOLED = f"""{_BT}, e AS (SELECT series, lead, y - p AS e FROM p WHERE model = 'mean'),
w AS (SELECT series, CAST(unnest(generate_series(lead - 3, lead + 3)) AS INTEGER) AS near, lead, e FROM e),
pooled AS (SELECT series, near AS lead, e, unnest(generate_series(1, 4 - abs(near - lead))) AS copy FROM w),
q AS (SELECT series, lead, quantile_cont(e, 0.05) AS a, quantile_cont(e, 0.95) AS b FROM pooled GROUP BY 1, 2),
f AS (SELECT series, avg(y) AS yhat, max(ds) AS last FROM odf GROUP BY 1)"""


@query("g12_pooled_interval", f"""WITH {_POOLED} SELECT series, CAST(lead AS INTEGER) AS lead, CAST(last + CAST(lead AS INTEGER) * INTERVAL 1 DAY AS DATE) AS ds,
{r('yhat', 2)} AS yhat, {r('yhat + a', 2)} AS lower, {r('yhat + b', 2)} AS upper FROM f JOIN q USING (series) WHERE lead BETWEEN 1 AND 30""")
def g12_pooled(spark, sf):
    """Errors of leads up to three days off, the nearer ones weighing more."""
    p, _ = backtest_days(order_days(spark, sf), ["mean"], "y", "ds", 30, 3, BY)
    d = bt.interval(baseline(stored_order_days(spark, sf), "mean", 30, by=BY), p, BY, pool=3)
    return d.select("series", "lead", "ds", *[rnd(c, 2).alias(c) for c in ("yhat", "lower", "upper")])


@query("g13_model_ranking", f"WITH {_BT} SELECT series, model, {r('score')} AS score, CAST(rank() OVER (PARTITION BY series ORDER BY score) AS INTEGER) AS rank FROM sc")
def g13(spark, sf):
    _, s = _backtest(spark, sf)
    return bt.rank_models(s, BY).select("series", "model", rnd("score").alias("score"), "rank")


@query("g14_fallback_chain", f"""WITH {_BT} SELECT a.series, a.ds, {r("CASE WHEN dayofmonth(a.ds) % 3 = 0 THEN b.p WHEN dayofmonth(a.ds) % 3 = 1 THEN c.p ELSE a.p END", 2)} AS yhat
FROM p a JOIN p b ON b.series = a.series AND b.fold = 1 AND b.ds = a.ds AND b.model = 'seasonal' JOIN p c ON c.series = a.series AND c.fold = 1 AND c.ds = a.ds AND c.model = 'last'
WHERE a.fold = 1 AND a.model = 'mean'""")
def g14(spark, sf):
    p, _ = backtest_days(order_days(spark, sf), MODELS, "y", "ds", 30, 1, BY)
    of = lambda m: p.where(F.col("model") == m).select("series", "ds", "yhat")
    k = F.pmod(F.day("ds"), F.lit(3))
    first = of("mean").withColumn("yhat", F.when(k == 2, F.col("yhat")))
    second = of("seasonal").withColumn("yhat", F.when(k == 0, F.col("yhat")))
    d = bt.with_fallback(first, second, of("last"), keys=["series", "ds"])
    return d.select("series", "ds", rnd("yhat", 2).alias("yhat"))


@query("g15_forecast_future", datepart_future_sql(ODF, 0.01, 60))
def g15(spark, sf):
    """Date-part regression fitted on every row, then the 60 days after the last."""
    from ..forecast.baselines import future_spine
    d = stored_order_days(spark, sf)
    f = fit_predict_datepart(d, future_spine(d, "ds", 60, BY), "y", "ds", BY, LinearForecaster("ridge", 0.01))
    from ..operators.scaling import clip_zero
    return f.select("series", "lead", "ds", rnd(clip_zero(F.col("yhat")), 0).alias("yhat"))


@query("g6_year_ahead_total", f"""WITH {ODF}, nx AS ({_NEXT}), f AS (SELECT series, last, CAST(unnest(generate_series(1, 365)) AS INTEGER) AS lead FROM nx)
SELECT f.series, CAST(min(f.last + f.lead * INTERVAL 1 DAY) AS DATE) AS forecast_start, CAST(max(f.last + f.lead * INTERVAL 1 DAY) AS DATE) AS forecast_end,
count(odf.y) AS days_counted, {r('sum(odf.y)', 1)} AS total_wh FROM f LEFT JOIN odf ON odf.series = f.series
AND odf.ds = CAST(f.last + (f.lead - CAST(ceil(f.lead / 7) AS INTEGER) * 7) * INTERVAL 1 DAY AS DATE) GROUP BY 1""")
def g6_total(spark, sf):
    from ..plans.year_ahead import year_ahead
    m = lambda hist, n: baseline(hist, "seasonal", n, by=BY)
    _, total = year_ahead(stored_order_days(spark, sf), m, by=BY)
    return total.withColumn("total_wh", rnd("total_wh", 1))


@query("g6_year_ahead_beside_naive", f"""WITH {ODF}, cu AS (SELECT series, max(ds) AS top, CAST(max(ds) - INTERVAL 100 DAY AS DATE) AS last FROM odf GROUP BY 1),
f AS (SELECT series, top, last, CAST(unnest(generate_series(1, 365)) AS INTEGER) AS lead FROM cu),
d AS (SELECT series, top, CAST(last + lead * INTERVAL 1 DAY AS DATE) AS ds, CAST(last + (lead - CAST(ceil(lead / 7) AS INTEGER) * 7) * INTERVAL 1 DAY AS DATE) AS src FROM f)
SELECT d.series, d.ds, {r('t.y', 2)} AS y, {r('greatest(s.y, 0)', 2)} AS yhat, {r('n.y', 2)} AS naive FROM d LEFT JOIN odf t ON t.series = d.series AND t.ds = d.ds
LEFT JOIN odf s ON s.series = d.series AND s.ds = d.src LEFT JOIN odf n ON n.series = d.series AND n.ds = least(CAST(d.ds - INTERVAL 1 DAY AS DATE), d.top)""")
def g6_beside(spark, sf):
    """A year from a hundred days before the end, beside the days known since and the last known day before each."""
    from ..plans.year_ahead import beside_naive, year_ahead
    truth = stored_order_days(spark, sf)
    last = truth.groupBy("series").agg(F.date_sub(F.max("ds"), 100).alias("last"))
    history = truth.join(last, "series").where("ds <= last").drop("last")
    forecast, _ = year_ahead(history, lambda hist, n: baseline(hist, "seasonal", n, by=BY), by=BY)
    d = beside_naive(forecast.select("series", "ds", "yhat"), truth, by=BY)
    return d.select("series", "ds", *[rnd(c, 2).alias(c) for c in ("y", "yhat", "naive")])
