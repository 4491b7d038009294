"""Scores (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import score as so
from ..session import cut_lineage, union_all
from .base import AOD, ED, EH, LD, ODF, all_order_days, event_days, event_hours, line_days, query, r, rnd, stored_order_days

BY = ["series"]
METRICS = ["mae", "mase_lag1", "rmse", "rmsse", "nmae", "nrmse", "mape", "smape", "r2"]

SPLIT = f"""{ODF}, sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 30 AS is_test,
lag(y) OVER (PARTITION BY series ORDER BY ds) AS lag1, lag(y, 7) OVER (PARTITION BY series ORDER BY ds) AS lag7 FROM odf),
tr AS (SELECT series, avg(abs(d)) AS dm, sqrt(avg(d * d)) AS dr FROM (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS d
  FROM sp WHERE NOT is_test) GROUP BY 1),
mn AS (SELECT series, avg(y) AS mean FROM sp WHERE NOT is_test GROUP BY 1)"""


def score_sql(source: str, keys: str, train_key: str = "series", tr: str = "tr", digits: int = 4) -> str:
    """All scores of ``source(keys, y, p)`` against the train scale ``tr``."""
    d = digits
    return f"""SELECT {keys}, n, {r('mae', 2)} AS mae, {r('mae / nullif(dm, 0)', d)} AS mase_lag1, {r('rmse', 2)} AS rmse,
{r('rmse / nullif(dr, 0)', d)} AS rmsse, {r('mae / nullif(my, 0)', d)} AS nmae, {r('rmse / nullif(my, 0)', d)} AS nrmse,
{r('mape', d)} AS mape, {r('smape', d)} AS smape, {r('1 - mse / nullif(vy, 0)', d)} AS r2 FROM (SELECT {keys}, count(*) AS n,
avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg((p - y) * (p - y)) AS mse, avg(y) AS my, var_pop(y) AS vy,
100 * avg(CASE WHEN abs(y) > 1e-9 THEN abs(p - y) / abs(y) END) AS mape, 100 * avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-9)) AS smape
FROM {source} GROUP BY ALL) LEFT JOIN {tr} USING ({train_key})"""


def rounded(df, keys):
    return df.select(*keys, "n", *[rnd(c, 2 if c in ("mae", "rmse") else 4).alias(c) for c in METRICS])


def split(spark, sf):
    d = stored_order_days(spark, sf)
    d = fe.naive_lag(d, "y", "ds", 1, BY, "lag1")
    d = fe.naive_lag(d, "y", "ds", 7, BY, "lag7")
    return fe.holdout(d, "ds", 30, BY)


@query("h1_h6_scores", f"WITH {SPLIT}, s AS (SELECT series, y, lag1 AS p FROM sp WHERE is_test) {score_sql('s', 'series')}")
def h1(spark, sf):
    train, test = split(spark, sf)
    return rounded(so.scores(test, train, "y", "lag1", "ds", BY), BY)


@query("h7_smape_skip", f"""WITH {SPLIT} SELECT series, {r('100 * avg(CASE WHEN abs(y) + abs(lag7) <> 0 THEN 2 * abs(lag7 - y) / (abs(y) + abs(lag7)) END)')} AS smape
FROM sp WHERE is_test GROUP BY 1""")
def h7(spark, sf):
    _, test = split(spark, sf)
    return test.groupBy("series").agg(rnd(so.smape_skip(F.col("y"), F.col("lag7"))).alias("smape"))


@query("h8_mase_lag365", f"""WITH {SPLIT}, d AS (SELECT series, avg(abs(d)) AS s FROM (SELECT series, y - lag(y, 365) OVER (PARTITION BY series ORDER BY ds) AS d
FROM sp WHERE NOT is_test) GROUP BY 1), m AS (SELECT series, avg(abs(lag7 - y)) AS mae FROM sp WHERE is_test GROUP BY 1)
SELECT series, {r('mae', 2)} AS mae, {r('mae / nullif(s, 0)')} AS mase_lag365 FROM m JOIN d USING (series)""")
def h8(spark, sf):
    train, test = split(spark, sf)
    d = so.mase_seasonal(test, train, 365, "y", "lag7", "ds", BY)
    return d.select("series", rnd("mae", 2).alias("mae"), rnd("mase_lag365").alias("mase_lag365"))


@query("h9_hourly_scores", f"""WITH {EH}, ef AS (SELECT event_type, ts, coalesce(value, avg(value) OVER (PARTITION BY event_type, hour(ts))) AS y FROM eh),
l AS (SELECT *, lag(y, 24) OVER w AS p, lag(y) OVER w AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM ef WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, {r('avg(abs(y - p))')} AS mae, {r('avg(abs(y - p)) / nullif(avg(abs(b - y)), 0)')} AS mase, {r('1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)')} AS r2,
{r('avg(coalesce(2 * abs(y - p) / nullif(abs(y) + abs(p), 0), 0))')} AS smape FROM l WHERE rn <= 48 AND p IS NOT NULL GROUP BY 1""")
def h9(spark, sf):
    from ..operators.resample import fill_hour_of_day
    by = ["event_type"]
    h = fill_hour_of_day(event_hours(spark, sf), "ts", ["value"], by)
    h = fe.mark_holdout(fe.naive_lag(h, "value", "ts", 24, by), "ts", 48, by)
    h = h.withColumn("yhat", F.when(F.col("is_test"), F.col("yhat")))
    d = so.scores_on_window(h, "value", "yhat", "ts", by)
    return d.select("event_type", *[rnd(c).alias(c) for c in ("mae", "mase", "r2", "smape")])


@query("h10_compare_models", f"""WITH {SPLIT}, s AS (SELECT series, 'lag1' AS model, y, lag1 AS p FROM sp WHERE is_test UNION ALL
SELECT series, 'lag7', y, lag7 FROM sp WHERE is_test UNION ALL SELECT series, 'mean', y, mean FROM sp JOIN mn USING (series) WHERE is_test)
{score_sql('s', 'series, model')}""")
def h10(spark, sf):
    train, test = split(spark, sf)
    preds = {"lag1": test.withColumnRenamed("lag1", "yhat"), "lag7": test.withColumnRenamed("lag7", "yhat"),
             "mean": fe.naive_mean(train, test, "y", BY)}
    return rounded(so.compare_models(test.select("series", "ds", "y"), preds, train, "ds", BY), ["series", "model"])


@query("h11_score_stored_forecast", f"""WITH {SPLIT}, s AS (SELECT series, y, lag7 AS p FROM sp WHERE is_test) {score_sql('s', 'series')}""")
def h11(spark, sf):
    days = stored_order_days(spark, sf)
    _, test = fe.holdout(fe.naive_lag(days, "y", "ds", 7, BY, "lag7"), "ds", 30, BY)
    # the stored forecast also covers ten days beyond the truth, which must not count
    f = test.select("series", "ds", F.col("lag7").alias("yhat"))
    f = union_all([f, f.groupBy("series").agg(F.max("ds").alias("m")).select(
        "series", F.explode(F.sequence(F.date_add("m", 1), F.date_add("m", 10))).alias("ds"), F.lit(0.0).alias("yhat"))])
    return rounded(so.score_stored(f, days, ts="ds", by=BY), BY)


@query("h12_per_variable_scores", f"""WITH {ED}, x AS (SELECT *, lag(y, 7) OVER (PARTITION BY series ORDER BY ds) AS p, row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 7 AS t FROM ed),
n AS (SELECT series, count(*) AS n_train, avg(abs(d)) AS dm FROM (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS d FROM x WHERE NOT t) GROUP BY 1),
g AS (SELECT series, count(*) AS n_valid, avg(abs(p - y)) AS mae, 100 * avg(2 * abs(p - y) / nullif(abs(y) + abs(p), 0)) AS sm, 1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0) AS r2 FROM x WHERE t GROUP BY 1)
SELECT series AS "column", n_train, n_valid, {r('mae / nullif(dm, 0)')} AS "MASE", {r('sm')} AS "SMAPE", {r('r2')} AS "R2" FROM g JOIN n USING (series)""")
def h12(spark, sf):
    train, test = fe.holdout(fe.naive_lag(cut_lineage(event_days(spark, sf)), "y", "ds", 7, BY), "ds", 7, BY)
    d = so.score_all(test, train, "series")
    return d.select("column", "n_train", "n_valid", rnd("MASE").alias("MASE"), rnd("SMAPE").alias("SMAPE"), rnd("R2").alias("R2"))


@query("h10_physical_vs_naive", f"""WITH {AOD}, {LD}, rg AS (SELECT min(price) AS a, max(price) AS b FROM ld), rf AS (SELECT min(y) AS lo, max(y) AS hi FROM aod),
ph AS (SELECT CAST(ds - INTERVAL 1000 DAY AS DATE) AS ds, (price - a) / (b - a) * (hi - lo) + lo AS v FROM ld, rg, rf), md AS (SELECT strftime(ds, '%m-%d') AS md, avg(v) AS v FROM ph GROUP BY 1),
x AS (SELECT ds, y, lag(y) OVER (ORDER BY ds) AS nv, row_number() OVER (ORDER BY ds DESC) <= 90 AS t FROM aod),
tr AS (SELECT 1 AS one, avg(abs(d)) AS dm, sqrt(avg(d * d)) AS dr FROM (SELECT y - lag(y) OVER (ORDER BY ds) AS d FROM x WHERE NOT t)),
s AS (SELECT 1 AS one, 'naive_lag1' AS model, y, nv AS p FROM x WHERE t UNION ALL
SELECT 1, 'physical', x.y, coalesce(ph.v, md.v) FROM x LEFT JOIN ph USING (ds) LEFT JOIN md ON md.md = strftime(x.ds, '%m-%d') WHERE t)
SELECT * EXCLUDE (one) FROM ({score_sql('s', 'one, model', 'one')})""")
def h10_physical(spark, sf):
    """A model series that ends before the scored days, so month-days stand in."""
    from ..operators.scaling import map_range
    from ..plans.forecast_scores import physical_vs_naive
    days = all_order_days(spark, sf)
    model = map_range(line_days(spark, sf), "price", days, "y", mapped="P_mapped_Wh").withColumn("ds", F.date_sub("ds", 1000))
    return rounded(physical_vs_naive(days, model, 90), ["model"])
