"""Joins and alignment (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as al
from ..operators.features import unpivot_series
from ..operators.resample import spine_between
from .base import AOD, ED, EH, LD, OD0, all_order_days, event_days, event_hours, events, line_days, order_days, query, r, rnd, table


def _orders(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds"))
            .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("n")))


def _lines(spark, sf):
    return (table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ship"))
            .agg(F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n")))


_O = "o AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"
_L = "l AS (SELECT CAST(l_shipdate AS DATE) AS ship, sum(l_extendedprice) AS price, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)"


@query("d1_left_join_days", f"""WITH {_O}, {_L} SELECT o.ds, {r('o.total', 2)} AS total, o.n, {r('l.price', 2)} AS price, l.n AS n_ext
FROM o LEFT JOIN l ON o.ds = l.ship""")
def d1(spark, sf):
    d = al.left_join_days(_orders(spark, sf), _lines(spark, sf), "ds", "ship")
    return d.select("ds", rnd("total", 2).alias("total"), "n", rnd("price", 2).alias("price"), "n_ext")


def _a_b(spark, sf):
    a = _orders(spark, sf).select(F.date_format("ds", "yyyy-MM-dd").alias("Date"), F.col("total").alias("Wh"), "n",
                                  F.date_format("ds", "yyyy-MM-dd").alias("LocalTime"))
    b = _lines(spark, sf).select(F.date_format("ship", "yyyy-MM-dd").alias("Date"), F.col("price").alias("Wh"), "n")
    return a, b


_AB = f"""{_O}, {_L}, a AS (SELECT strftime(ds, '%Y-%m-%d') AS "Date", total AS "Wh", n, strftime(ds, '%Y-%m-%d') AS "LocalTime" FROM o),
b AS (SELECT strftime(ship, '%Y-%m-%d') AS "Date", price AS "Wh", n FROM l)"""


def _merge(how):
    def f(spark, sf):
        d = al.merge_by_date(*_a_b(spark, sf), how)
        return d.select("Date", rnd("Wh_a", 2).alias("Wh_a"), "n_a", rnd("Wh_b", 2).alias("Wh_b"), "n_b")
    return f


for _how, _join in (("outer", "FULL"), ("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT")):
    query(f"d2_{_how}_join_by_date", f"""WITH {_AB} SELECT coalesce(a."Date", b."Date") AS "Date", {r('a."Wh"', 2)} AS "Wh_a", a.n AS n_a,
{r('b."Wh"', 2)} AS "Wh_b", b.n AS n_b FROM a {_join} JOIN b ON a."Date" IS NOT DISTINCT FROM b."Date" """)(_merge(_how))


@query("d3_d4_coalesce_and_order", f"""WITH {_AB} SELECT coalesce(a."Date", b."Date") AS "Date",
coalesce(a."LocalTime", a."Date", b."Date") AS "LocalTime", {r('coalesce(a."Wh", b."Wh")', 2)} AS "Wh", coalesce(a.n, b.n) AS n
FROM a FULL JOIN b ON a."Date" = b."Date" """)
def d34(spark, sf):
    d = al.dates_first(al.coalesce_pairs(al.merge_by_date(*_a_b(spark, sf))))
    return d.withColumn("Wh", rnd("Wh", 2))


@query("d5_merge_forecasts", f"""WITH {ED} SELECT ds, {', '.join(r(f"max(CASE WHEN series = '{t}' THEN y END)", 2) + f' AS "{t}"'
       for t in ('click', 'error', 'purchase', 'signup', 'view'))} FROM ed GROUP BY 1""")
def d5(spark, sf):
    d = al.merge_forecasts(event_days(spark, sf), "ds", "series", "y")
    return d.select("ds", *[rnd(c, 2).alias(c) for c in d.columns if c != "ds"])


_TARGET = "t AS (SELECT CAST(unnest(generate_series(min(ds), max(ds) + INTERVAL 200 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM aod)"


def _target(spark, sf):
    b = all_order_days(spark, sf).agg(F.min("ds").alias("a"), F.date_add(F.max("ds"), 200).alias("b"))
    return spine_between(b, "a", "b", "day")


@query("d6_reindex_to_dates", f"WITH {AOD}, {_TARGET} SELECT t.ds, {r('y', 2)} AS y FROM t LEFT JOIN aod USING (ds)")
def d6(spark, sf):
    return al.align(all_order_days(spark, sf), _target(spark, sf), ["ds"]).select("ds", rnd("y", 2).alias("y"))


@query("d7_month_day_fallback", f"""WITH {AOD}, {_TARGET}, m AS (SELECT strftime(ds, '%m-%d') AS md, avg(y) AS y FROM aod GROUP BY 1)
SELECT t.ds, {r('coalesce(aod.y, m.y)', 2)} AS y FROM t LEFT JOIN aod USING (ds) LEFT JOIN m ON strftime(t.ds, '%m-%d') = m.md""")
def d7(spark, sf):
    d = al.align_month_day(all_order_days(spark, sf), _target(spark, sf), "ds", "y")
    return d.select("ds", rnd("y", 2).alias("y"))


@query("d7_month_day_fallback_by_series", f"""WITH {OD0}, s AS (SELECT series,
CAST(unnest(generate_series(min(ds), max(ds) + INTERVAL 100 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM od0 GROUP BY 1),
m AS (SELECT series, strftime(ds, '%m-%d') AS md, avg(y) AS y FROM od0 GROUP BY 1, 2)
SELECT s.series, s.ds, {r('coalesce(o.y, m.y)', 2)} AS y FROM s LEFT JOIN od0 o USING (series, ds)
LEFT JOIN m ON m.series = s.series AND m.md = strftime(s.ds, '%m-%d')""")
def d7_by(spark, sf):
    o = order_days(spark, sf, full=False)
    t = spine_between(o.groupBy("series").agg(F.min("ds").alias("a"), F.date_add(F.max("ds"), 100).alias("b")), "a", "b", "day")
    return al.align_month_day(o, t, "ds", "y", ["series"]).select("series", "ds", rnd("y", 2).alias("y"))


@query("d8_typical_year", f"""WITH {EH}, ty AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1),
k AS (SELECT strftime(t, '%m-%d-%H') AS key, avg(v) AS v FROM ty GROUP BY 1)
SELECT eh.event_type, eh.ts, {r('k.v')} AS tmy_G FROM eh LEFT JOIN k ON k.key = strftime(eh.ts - INTERVAL 8 HOUR, '%m-%d-%H')""")
def d8(spark, sf):
    from ..operators.resample import resample
    typical = resample(events(spark, sf).select("ts", F.col("value").alias("G(h)")), "ts", "hour", {"G(h)": "mean"}, full=False)
    d = al.align_typical_year(event_hours(spark, sf), typical, "ts", "ts", ["G(h)"])
    return d.select("event_type", "ts", rnd("tmy_G").alias("tmy_G"))


def _ff(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("d9_align_and_fill", f"WITH {AOD}, {_TARGET}, j AS (SELECT t.ds, y FROM t LEFT JOIN aod USING (ds)) SELECT ds, {r(_ff('y'), 2)} AS y FROM j")
def d9(spark, sf):
    return al.align_fill(all_order_days(spark, sf), _target(spark, sf), "ds", ["y"]).select("ds", rnd("y", 2).alias("y"))


@query("d10_merge_regressors", f"""WITH {AOD}, {_TARGET}, {LD}, {_L},
j AS (SELECT t.ds, ld.qty, ld.disc, l.n AS n FROM t LEFT JOIN ld USING (ds) LEFT JOIN l ON l.ship = t.ds)
SELECT ds, {r(_ff('qty'), 2)} AS qty, {r(_ff('disc'))} AS disc, {r(_ff('n'))} AS n FROM j""")
def d10(spark, sf):
    left = line_days(spark, sf).select("ds", "qty", "disc")
    right = _lines(spark, sf).select(F.col("ship").alias("ds"), F.lit("no number").alias("qty"), "n")
    d = al.merge_regressors(_target(spark, sf), [left, right], "ds")
    return d.select("ds", rnd("qty", 2).alias("qty"), rnd("disc").alias("disc"), rnd("n").alias("n"))


@query("d11_shared_columns", """SELECT 'ds,price,qty' AS shared, CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem""")
def d11(spark, sf):
    a = line_days(spark, sf)
    b = a.select("qty", "ds", "price", F.lit(1).alias("other"))
    return a.agg(F.lit(",".join(al.common_columns(a, b))).alias("shared"), F.count(F.lit(1)).alias("days"))


@query("d12_overlap", f"WITH {AOD}, {LD} SELECT ds, {r('y', 2)} AS y, {r('price', 2)} AS price FROM aod JOIN ld USING (ds)")
def d12(spark, sf):
    d = al.overlap(all_order_days(spark, sf), line_days(spark, sf).select("ds", "price"), ["ds"])
    return d.select("ds", rnd("y", 2).alias("y"), rnd("price", 2).alias("price"))


@query("e16_unpivot_variables", f"""WITH {LD} SELECT ds, 'qty' AS variable, {r('qty', 2)} AS y FROM ld UNION ALL
SELECT ds, 'price', {r('price', 2)} FROM ld WHERE disc > 0.05 UNION ALL SELECT ds, 'disc', {r('disc')} FROM ld""")
def e16(spark, sf):
    d = line_days(spark, sf).select("ds", rnd("qty", 2).alias("qty"), rnd("disc").alias("disc"),
                                    F.when(F.col("disc") > 0.05, rnd("price", 2)).alias("price"))
    return unpivot_series(d, ["ds"], ["qty", "price", "disc"])
