"""Fills, lags, rolling windows, calendar, naive baselines, split, weights (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from .base import OD, ODF, order_days, order_days_filled, query, r, rnd, stored_order_days, table

BY = ["series"]
_UP = "OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_F, _B = f"last_value(y IGNORE NULLS) {_UP}", f"first_value(y IGNORE NULLS) {_DOWN}"


@query("e1_fills", f"""WITH {OD} SELECT series, ds, {r(f'coalesce({_F}, {_B})', 2)} AS forward, {r(f'coalesce({_B}, {_F})', 2)} AS backward,
{r(_F, 2)} AS forward_only, {r('coalesce(y, 0)', 2)} AS zero FROM od""")
def e1(spark, sf):
    d = order_days(spark, sf).select("*", *[F.col("y").alias(n) for n in ("forward", "backward", "forward_only", "zero")])
    d = fe.fill(d, ["forward"], "ds", BY, "ffill")
    d = fe.fill(d, ["backward"], "ds", BY, "bfill")
    d = fe.fill(d, ["forward_only"], "ds", BY, "ffill", both=False)
    d = fe.fill(d, ["zero"], "ds", BY, "zero")
    return d.select("series", "ds", *[rnd(c, 2).alias(c) for c in ("forward", "backward", "forward_only", "zero")])




def _lag_sql(ns):
    return ", ".join(f"{r(f'lag(y, {n}) OVER w', 2)} AS y_lag{n}" for n in ns)


@query("e2_lags", f"WITH {ODF} SELECT series, ds, {_lag_sql((1, 7, 14, 30, 365))} FROM odf WINDOW w AS (PARTITION BY series ORDER BY ds)")
def e2(spark, sf):
    d = fe.lags(order_days_filled(spark, sf), "y", "ds", (1, 7, 14, 30, 365), BY)
    return d.select("series", "ds", *[rnd(c, 2).alias(c) for c in d.columns if c.startswith("y_")])


_ROLLS = ", ".join(f"{r(f'avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 2)} AS y_roll_mean_{n}, "
                   f"{r(f'coalesce(stddev_samp(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)', 2)} AS y_roll_std_{n}"
                   for n in (7, 14, 30))


@query("e3_rolling", f"WITH {ODF} SELECT series, ds, {_ROLLS} FROM odf")
def e3(spark, sf):
    d = fe.rolling(order_days_filled(spark, sf), "y", "ds", (7, 14, 30), BY)
    return d.select("series", "ds", *[rnd(c, 2).alias(c) for c in d.columns if c.startswith("y_")])


@query("e2_e3_in_chunks", f"WITH {ODF} SELECT series, ds, {_lag_sql((1, 7, 14, 30))}, {_ROLLS} FROM odf WINDOW w AS (PARTITION BY series ORDER BY ds)")
def e23_chunks(spark, sf):
    """The same windows cut into spans of 256 days with a halo."""
    d = fe.lags(order_days_filled(spark, sf), "y", "ds", (1, 7, 14, 30), BY, width=256)
    d = fe.rolling(d, "y", "ds", (7, 14, 30), BY, width=256)
    return d.select("series", "ds", *[rnd(c, 2).alias(c) for c in d.columns if c.startswith("y_")])


def _lines_by_flag(spark, sf):
    return (table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("ds"))
            .agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.max("l_tax").alias("tax")))


_RM = ", ".join(f"{r(f'avg({c}) OVER w')} AS {c}_roll7" for c in ("qty", "disc", "tax"))


@query("e4_regressor_rolling_means", f"""WITH l AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS qty,
avg(l_discount) AS disc, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2) SELECT series, ds, {_RM} FROM l
WINDOW w AS (PARTITION BY series ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def e4(spark, sf):
    d = fe.rolling_means(_lines_by_flag(spark, sf), ["qty", "disc", "tax"], "ds", 7, BY)
    return d.select("series", "ds", *[rnd(f"{c}_roll7").alias(f"{c}_roll7") for c in ("qty", "disc", "tax")])


@query("e5_e6_calendar", f"""SELECT o_orderkey, CAST(isodow(d) - 1 AS INTEGER) AS dayofweek, CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend,
CAST(month(d) AS INTEGER) AS month, CAST(dayofyear(d) AS INTEGER) AS dayofyear, {r('sin(2 * pi() * dayofyear(d) / 365.25)', 6)} AS dayofyear_sin,
{r('cos(2 * pi() * dayofyear(d) / 365.25)', 6)} AS dayofyear_cos FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def e5(spark, sf):
    d = fe.add_calendar(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")
    return d.withColumn("dayofyear_sin", rnd("dayofyear_sin", 6)).withColumn("dayofyear_cos", rnd("dayofyear_cos", 6))


_UNKNOWN = "(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders)"


def _some_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("d"))


@query("e7_harmonics", f"""SELECT o_orderkey, {', '.join(f"{r(f'{f}(2 * pi() * {k} * coalesce(dayofyear(d), 0) / 365.0)', 6)} AS {f}_DOY_k{k}"
       for k in (1, 2, 3) for f in ('sin', 'cos'))} FROM {_UNKNOWN}""")
def e7(spark, sf):
    d = fe.add_harmonics(_some_dates(spark, sf), "d").drop("d")
    return d.select("o_orderkey", *[rnd(c, 6).alias(c) for c in d.columns if c != "o_orderkey"])


@query("e8_dummies", f"""SELECT o_orderkey, {', '.join(f'CAST(coalesce(month(d) = {i}, false) AS INTEGER) AS month_{i}' for i in range(2, 13))},
CAST(coalesce(month(d) IN (9, 10, 11), false) AS INTEGER) AS season_autumn, CAST(coalesce(month(d) IN (3, 4, 5), false) AS INTEGER) AS season_spring,
CAST(coalesce(month(d) IN (6, 7, 8), false) AS INTEGER) AS season_summer, CAST(coalesce(isodow(d) >= 6, false) AS INTEGER) AS is_weekend FROM {_UNKNOWN}""")
def e8(spark, sf):
    return fe.add_dummies(_some_dates(spark, sf), "d").drop("d")


_TEST = "QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 30"


@query("e9_naive_lag1", f"WITH {ODF} SELECT series, ds, {r('y', 2)} AS y, {r('lag(y) OVER (PARTITION BY series ORDER BY ds)', 2)} AS yhat FROM odf {_TEST}")
def e9(spark, sf):
    d = fe.mark_holdout(fe.naive_lag(order_days_filled(spark, sf), "y", "ds", 1, BY), "ds", 30, BY)
    return d.where("is_test").select("series", "ds", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


@query("e10_naive_carry", f"""WITH {OD} SELECT series, ds, {r('last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 2)} AS yhat FROM od""")
def e10(spark, sf):
    return fe.naive_carry(order_days(spark, sf), "y", "ds", BY).select("series", "ds", rnd("yhat", 2).alias("yhat"))


@query("e11_naive_lag365", f"WITH {ODF} SELECT series, ds, {r('lag(y, 365) OVER (PARTITION BY series ORDER BY ds)', 2)} AS yhat FROM odf {_TEST}")
def e11(spark, sf):
    d = fe.mark_holdout(fe.naive_lag(order_days_filled(spark, sf), "y", "ds", 365, BY), "ds", 30, BY)
    return d.where("is_test").select("series", "ds", rnd("yhat", 2).alias("yhat"))


_SPLIT = f"""{ODF}, sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 30 AS is_test FROM odf)"""


@query("e12_naive_mean", f"WITH {_SPLIT}, m AS (SELECT series, avg(y) AS yhat FROM sp WHERE NOT is_test GROUP BY 1) SELECT series, ds, {r('yhat', 2)} AS yhat FROM sp JOIN m USING (series) WHERE is_test")
def e12(spark, sf):
    train, test = fe.holdout(stored_order_days(spark, sf), "ds", 30, BY)
    return fe.naive_mean(train, test, "y", BY).select("series", "ds", rnd("yhat", 2).alias("yhat"))


@query("e13_trailing_mean_fill", f"""WITH RECURSIVE {OD}, n AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS i FROM od),
f AS (SELECT series, i, ds, coalesce(y, 0) AS v, [coalesce(y, 0)] AS seen FROM n WHERE i = 1
UNION ALL SELECT n.series, n.i, n.ds, coalesce(n.y, CASE WHEN len(f.seen) >= 30 THEN list_avg(f.seen) ELSE f.seen[-1] END),
  list_append(CASE WHEN len(f.seen) >= 30 THEN f.seen[2:] ELSE f.seen END, coalesce(n.y, CASE WHEN len(f.seen) >= 30 THEN list_avg(f.seen) ELSE f.seen[-1] END))
FROM f JOIN n ON n.series = f.series AND n.i = f.i + 1) SELECT series, ds, {r('v', 2)} AS y FROM f""")
def e13(spark, sf):
    return fe.fill_trailing_mean(order_days(spark, sf), "y", "ds", BY).select("series", "ds", rnd("y", 2).alias("y"))


@query("e14_holdout", f"WITH {_SPLIT} SELECT series, is_test, count(*) AS n, min(ds) AS first_day, max(ds) AS last_day FROM sp GROUP BY 1, 2")
def e14(spark, sf):
    return fe.mark_holdout(order_days_filled(spark, sf), "ds", 30, BY).groupBy("series", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


@query("e15_feature_weights", f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS t FROM lineitem),
u AS (SELECT 'l_quantity' AS "column", a AS corr FROM c UNION ALL SELECT 'l_discount', b FROM c UNION ALL SELECT 'l_tax', t FROM c UNION ALL SELECT 'constant', 0.0 FROM c)
SELECT "column", {r('corr', 6)} AS corr, {r('abs(corr)', 6)} AS abs_corr, {r('abs(corr) / sum(abs(corr)) OVER ()', 6)} AS weight FROM u""")
def e15(spark, sf):
    d = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax", F.lit(3.0).alias("constant"))
    w = fe.feature_weights(d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "constant"])
    return w.select("column", rnd("corr", 6).alias("corr"), rnd("abs_corr", 6).alias("abs_corr"), rnd("weight", 6).alias("weight"))


@query("e15_top_features_by_series", f"""WITH c AS (SELECT l_returnflag AS series, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS t FROM lineitem GROUP BY 1),
u AS (SELECT series, 'l_quantity' AS "column", a AS corr FROM c UNION ALL SELECT series, 'l_discount', b FROM c UNION ALL SELECT series, 'l_tax', t FROM c),
w AS (SELECT *, abs(corr) / sum(abs(corr)) OVER (PARTITION BY series) AS weight FROM u)
SELECT series, "column", {r('weight', 6)} AS weight FROM w QUALIFY row_number() OVER (PARTITION BY series ORDER BY weight DESC, "column") <= 2""")
def e15_top(spark, sf):
    d = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "series")
    w = fe.feature_weights(d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], BY, top_n=2)
    return w.select("series", "column", rnd("weight", 6).alias("weight"))


@query("e1_e5_model_features", f"""WITH {ODF} SELECT series, ds, {r('y', 2)} AS y, {r('lag(y, 7) OVER w', 2)} AS y_lag7,
{r('avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 2)} AS y_roll_mean_30,
CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek FROM odf WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def e_block(spark, sf):
    d = fe.model_features(order_days(spark, sf), "y", [], "ds", BY)
    return d.select("series", "ds", rnd("y", 2).alias("y"), rnd("y_lag7", 2).alias("y_lag7"),
                    rnd("y_roll_mean_30", 2).alias("y_roll_mean_30"), "dayofweek")
