"""Range mapping, min-max scaling, year projection, series transforms (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scaling as sc
from ..session import cut_lineage, union_all
from .base import AOD, ED, LD, ODF, all_order_days, event_days, line_days, stored_order_days, query, r, rnd, table

BY = ["series"]


@query("f1_map_range", f"""WITH {LD}, {AOD}, o AS (SELECT min(price) AS a, max(price) AS b FROM ld), s AS (SELECT min(y) AS lo, max(y) AS hi FROM aod)
SELECT ds, {r('(price - a) / (b - a) * (hi - lo) + lo', 2)} AS mapped, {r('(price - lo) / (hi - lo)', 6)} AS normalised FROM ld, o, s""")
def f1(spark, sf):
    d = sc.map_range(cut_lineage(line_days(spark, sf)), "price", all_order_days(spark, sf), "y", mapped="mapped", normalised="normalised")
    return d.select("ds", rnd("mapped", 2).alias("mapped"), rnd("normalised", 6).alias("normalised"))


@query("f1_map_range_by_series", f"""WITH {ODF}, l AS (SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS ds, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
q AS (SELECT l_linestatus AS series, l_quantity AS q FROM lineitem), o AS (SELECT series, min(price) AS a, max(price) AS b FROM l GROUP BY 1),
s AS (SELECT series, min(q) AS lo, max(q) AS hi FROM q GROUP BY 1)
SELECT series, ds, {r('(price - a) / (b - a) * (hi - lo) + lo')} AS mapped FROM l JOIN o USING (series) JOIN s USING (series)""")
def f1_by(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "series")
    days = l.groupBy("series", F.col("l_shipdate").cast("date").alias("ds")).agg(F.sum("l_extendedprice").alias("price"))
    d = sc.map_range(days, "price", l, "l_quantity", BY, mapped="mapped")
    return d.select("series", "ds", rnd("mapped").alias("mapped"))


@query("f2_normalise_by_reference", f"""WITH {LD}, {AOD}, s AS (SELECT min(y) AS lo, max(y) AS hi FROM aod)
SELECT ds, {r('(price - lo) / (hi - lo)', 6)} AS p FROM ld, s""")
def f2(spark, sf):
    d = sc.normalise_by_ref(line_days(spark, sf), "price", all_order_days(spark, sf), "y", out="p")
    return d.select("ds", rnd("p", 6).alias("p"))


@query("f3_reference_statistics", f"""WITH l AS (SELECT l_returnflag AS series, l_quantity AS v FROM lineitem UNION ALL
SELECT 'price', l_extendedprice FROM lineitem), g AS (SELECT series, CASE WHEN median(v) >= 1000 THEN 1 ELSE 1000 END AS k,
min(v) AS lo, max(v) AS hi, count(v) AS count FROM l GROUP BY 1)
SELECT series, CASE WHEN k = 1 THEN 'wh' ELSE 'kwh' END AS unit_detected, {r('lo * k', 2)} AS min_wh, {r('hi * k', 2)} AS max_wh,
{r('lo * k / 1000', 2)} AS min_kwh, {r('hi * k / 1000', 2)} AS max_kwh, count FROM g""")
def f3(spark, sf):
    l = table(spark, sf, "lineitem")
    both = union_all([l.select(F.col("l_returnflag").alias("series"), F.col("l_quantity").alias("v")),
                      l.select(F.lit("price").alias("series"), F.col("l_extendedprice").alias("v"))])
    s = sc.ref_stats(both, "v", BY)
    return s.select("series", "unit_detected", *[rnd(c, 2).alias(c) for c in ("min_wh", "max_wh", "min_kwh", "max_kwh")], "count")


@query("f4_minmax_by_reference", f"""WITH {AOD}, l AS (SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_extendedprice) AS w, avg(l_extendedprice) AS m,
count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT min(y) AS lo, max(y) AS hi FROM aod)
SELECT ds, {r('least(greatest((w - lo) / (hi - lo), 0.0), 1.0)', 6)} AS "P_Wh", {r('least(greatest((w - lo) / (hi - lo), 0.0), 1.0)', 6)} AS "P_kWh",
{r('least(greatest((m * n - lo) / (hi - lo), 0.0), 1.0)', 6)} AS "P_mean" FROM l, s""")
def f4(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ds")).agg(
        F.sum("l_extendedprice").alias("P_Wh"), (F.sum("l_extendedprice") / 1000).alias("P_kWh"),
        F.avg("l_extendedprice").alias("P_mean"), F.count(F.lit(1)).alias("n_obs_P"))
    stats = sc.ref_stats(all_order_days(spark, sf), "y", unit="wh")
    cols = ["P_Wh", "P_kWh", "P_mean", "absent"]
    d = sc.minmax_by_ref(l, cols, stats, clip=True, suffix="_s")
    return d.select("ds", *[rnd(f"{c}_s", 6).alias(c) for c in cols[:3]])


@query("f5_project_year", """SELECT o_orderkey, make_timestamp(2005, month(o_orderdate), day(o_orderdate), o_orderkey % 24, 0, 0) + INTERVAL 8 HOUR AS local_time
FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def f5(spark, sf):
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", ts.alias("t"))
    years = F.create_map(*[F.lit(v) for m in range(1, 13) for v in (m, 2005 + (m * 5) % 12)])
    return sc.project_year(o, "t", years).select("o_orderkey", "local_time")


_T = f"""{ODF}, st AS (SELECT series, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi,
regr_slope(y, date_diff('day', DATE '1970-01-01', ds)) AS b, regr_intercept(y, date_diff('day', DATE '1970-01-01', ds)) AS a FROM odf GROUP BY 1)"""


@query("f6_transforms", f"""WITH {_T} SELECT series, ds, {r('y - lag(y) OVER w', 2)} AS difference, {r('y - lag(y, 7) OVER w', 2)} AS seasonal_difference,
{r('(y - mean) / sd')} AS zscore, {r('(y - lo) / (hi - lo)')} AS minmax, {r("y - (a + b * date_diff('day', DATE '1970-01-01', ds))", 1)} AS detrend,
{r('least(greatest(y, mean - 3 * sd), mean + 3 * sd)', 2)} AS clip_outliers FROM odf JOIN st USING (series) WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def f6(spark, sf):
    d = sc.transforms(stored_order_days(spark, sf), {n: n for n in sc.TRANSFORMS}, "y", "ds", BY)
    digits = {"zscore": 4, "minmax": 4, "detrend": 1}
    return d.select("series", "ds", *[rnd(n, digits.get(n, 2)).alias(n) for n in sc.TRANSFORMS])


@query("f6_inverse_transforms", f"""WITH {ED} SELECT series, ds, {', '.join(f'{r("y", 2)} AS {n}' for n in sc.TRANSFORMS if n != 'clip_outliers')} FROM ed""")
def f6_inverse(spark, sf):
    src = cut_lineage(event_days(spark, sf))
    stats = sc.series_stats(src, "y", "ds", BY)
    d = src
    for name in sc.TRANSFORMS:
        if name != "clip_outliers":
            d = sc.transform(d, name, "y", "ds", BY, out=f"z_{name}")
            d = sc.inverse(d, name, f"z_{name}", stats, "ds", BY, out=name, first="y")
    return d.select("series", "ds", *[rnd(n, 2).alias(n) for n in sc.TRANSFORMS if n != "clip_outliers"])


@query("f7_no_negatives", f"SELECT event_id, {r('greatest(value - 50, 0)')} AS yhat FROM events")
def f7(spark, sf):
    return table(spark, sf, "events").select("event_id", rnd(sc.clip_zero(F.col("value") - 50)).alias("yhat"))
