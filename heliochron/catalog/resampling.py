"""Resampling, gap filling, daily blocks and totals (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as rs
from ..operators.ordered import join_keys
from ..plans.energy_days import minutes_to_days
from .base import ED, EH, OD0, event_days, event_hours, events, order_days, query, r, rnd, table

TYPE = ["event_type"]

_FILLED = f"""{EH}, ef AS (SELECT event_type, ts, coalesce(value, avg(value) OVER (PARTITION BY event_type, hour(ts))) AS value FROM eh)"""


@query("c1_hourly_mean_full_spine", f"WITH {EH} SELECT event_type, ts, {r('value')} AS value FROM eh")
def c1(spark, sf):
    return event_hours(spark, sf).select("event_type", "ts", rnd("value").alias("value"))


@query("c2_clock_hour_fill", f"WITH {_FILLED} SELECT event_type, ts, {r('value')} AS value FROM ef")
def c2(spark, sf):
    d = rs.fill_hour_of_day(event_hours(spark, sf), "ts", ["value"], TYPE)
    return d.select("event_type", "ts", rnd("value").alias("value"))


@query("c1_c2_c3_minutes_to_days", f"""WITH {_FILLED} SELECT event_type, CAST(ts AS DATE) AS ts, {r('sum(value)')} AS "Wh",
{r('avg(value)')} AS level FROM ef GROUP BY 1, 2""")
def c123(spark, sf):
    e = events(spark, sf).select("event_type", "ts", F.col("value").alias("W"), F.col("value").alias("level"))
    d = minutes_to_days(e, "ts", "W", ["level"], TYPE)
    return d.select("event_type", "ts", rnd("Wh").alias("Wh"), rnd("level").alias("level"))


_LOGGED = f"""w0 AS (SELECT event_type, event_id, value, CASE WHEN event_id % 97 = 0 AND event_id > 500 THEN NULL ELSE date_trunc('second', ts) END AS t,
row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
w1 AS (SELECT *, last_value(t IGNORE NULLS) OVER o AS lt, last_value(CASE WHEN t IS NOT NULL THEN rn END IGNORE NULLS) OVER o AS ln FROM w0
WINDOW o AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fx AS (SELECT event_type, lt + (rn - ln) * INTERVAL 1 MINUTE AS ts, value FROM w1), {_FILLED.replace('FROM events', 'FROM fx')},
hr AS (SELECT event_type, CAST(ts AS DATE) AS d, round(value, 5) AS value FROM ef), we AS (SELECT CAST(ts AS DATE) AS d, avg(user_id) AS temp FROM events GROUP BY 1)"""


@query("c3_logger_text_to_days_with_weather", f"""WITH {_LOGGED} SELECT event_type, d AS "LocalTime", {r('sum(value)', 2)} AS "Wh", {r('avg(value)', 3)} AS level, {r('any_value(temp)')} AS temp,
{r('any_value(CASE WHEN temp IS NOT NULL THEN sin(2 * pi() * dayofyear(d) / 365.0) END)', 6)} AS "sin_DOY_k1" FROM hr LEFT JOIN we USING (d) GROUP BY 1, 2""")
def c3_logger(spark, sf):
    """Lines as the logger writes them, with repeated headers and lost times, to days beside the weather's."""
    from ..plans.energy_days import logger_days, with_weather
    e = events(spark, sf)
    lost = (F.col("event_id") % 97 == 0) & (F.col("event_id") > 500)
    text = F.when(lost, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.struct(text.alias("LocalTime"), F.col("value").cast("string").alias("W"), F.col("value").cast("string").alias("level"))
    head = F.struct(F.lit("LocalTime").alias("LocalTime"), F.lit("W").alias("W"), F.lit("level").alias("level"))
    lines = F.when(F.col("event_id") % 1000 == 0, F.array(head, line)).otherwise(F.array(line))
    d = e.select("event_type", "event_id", F.inline(lines))
    weather = e.groupBy(F.col("ts").cast("date").alias("Date")).agg(F.avg("user_id").alias("temp"))
    days = logger_days(d, "event_id", TYPE, measures=("level",)).withColumn("LocalTime", F.col("LocalTime").cast("date"))
    out = with_weather(days, weather)
    return out.select("event_type", "LocalTime", rnd("Wh", 2).alias("Wh"), rnd("level", 3).alias("level"), rnd("temp").alias("temp"), rnd("sin_DOY_k1", 6).alias("sin_DOY_k1"))


@query("c3_daily_energy_no_spine", f"""SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds,
{r('sum(o_totalprice)', 2)} AS total, {r('avg(o_custkey)')} AS cust FROM orders GROUP BY 1, 2""")
def c3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ds"),
                                          F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("cust"))
    d = rs.daily_energy(o, "ds", ["total"], ["cust"], ["series"])
    return d.select("series", "ds", rnd("total", 2).alias("total"), rnd("cust").alias("cust"))


@query("c4_daily_sum_full_spine", f"""WITH {OD0}, s AS (SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
FROM od0 GROUP BY 1) SELECT s.series, s.ds, {r('coalesce(y, 0)', 2)} AS y FROM s LEFT JOIN od0 USING (series, ds)""")
def c4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ds"),
                                          F.col("o_totalprice").alias("y"))
    return rs.resample(o, "ds", "day", {"y": "sum"}, ["series"]).select("series", "ds", rnd("y", 2).alias("y"))


@query("c5_monthly_energy", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def c5(spark, sf):
    d = rs.monthly_energy(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", out="total")
    return d.select("month", rnd("total", 2).alias("total"))


@query("c5_monthly_energy_by_series", f"""SELECT event_type, strftime(ts, '%Y-%m') AS month, {r('sum(value)', 2)} AS value_sum
FROM events GROUP BY 1, 2""")
def c5_by(spark, sf):
    d = rs.monthly_energy(events(spark, sf), "ts", "value", TYPE)
    return d.select("event_type", "month", rnd("value_sum", 2).alias("value_sum"))


@query("c6_day_spine", f"WITH {OD0} SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM od0 GROUP BY 1")
def c6(spark, sf):
    return order_days(spark, sf).select("series", "ds")


_STEP = """st AS (SELECT event_type, quantile_cont(g, 0.5) AS med FROM (SELECT event_type,
epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events) WHERE g IS NOT NULL GROUP BY 1)"""


@query("c7_step_estimate", f"WITH {_STEP} SELECT event_type, {r('med / 3600e6', 6)} AS step_hours FROM st")
def c7(spark, sf):
    return rs.step_hours(events(spark, sf), "ts", TYPE).select("event_type", rnd("step_hours", 6).alias("step_hours"))


@query("c8_power_to_energy", f"""WITH {_STEP}, d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS w FROM events GROUP BY 1, 2)
SELECT event_type, day, {r('w * med / 3600e6')} AS wh, {r('w * med / 3600e9', 6)} AS kwh FROM d JOIN st USING (event_type)""")
def c8(spark, sf):
    # the step is constant in a series, so it is applied to day sums, not to the raw rows
    e = events(spark, sf)
    d = e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("w"))
    d = join_keys(d, rs.step_hours(e, "ts", TYPE), TYPE)
    w, h = F.col("w"), F.col("step_hours")
    return d.select("event_type", "day", rnd(rs.to_energy(w, h)).alias("wh"),
                    rnd(rs.to_energy(w, h, kilo=True), 6).alias("kwh"))


_BLOCK = [("price_sum", "l_extendedprice", "sum"), ("price_mean", "l_extendedprice", "mean"),
          ("price_min", "l_extendedprice", "min"), ("price_max", "l_extendedprice", "max"),
          ("price_std", "l_extendedprice", "std"), ("price_p10", "l_extendedprice", "p10"),
          ("price_p90", "l_extendedprice", "p90"), ("qty_mean", "l_quantity", "mean"), ("qty_p90", "l_quantity", "p90"),
          ("n_obs_qty", "l_quantity", "count"), ("valid_frac_qty", "l_quantity", "frac")]


@query("c9_daily_statistics", f"""WITH g AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
sum(l_extendedprice) AS price_sum, avg(l_extendedprice) AS price_mean, min(l_extendedprice) AS price_min,
max(l_extendedprice) AS price_max, stddev_samp(l_extendedprice) AS price_std,
quantile_cont(l_extendedprice, 0.1) AS price_p10, quantile_cont(l_extendedprice, 0.9) AS price_p90,
avg(l_quantity) AS qty_mean, quantile_cont(l_quantity, 0.9) AS qty_p90, count(l_quantity) AS n_obs_qty,
count(l_quantity) / count(*) AS valid_frac_qty FROM lineitem GROUP BY 1, 2),
s AS (SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM g GROUP BY 1)
SELECT s.series, s.date, {r('coalesce(price_sum, 0)', 2)} AS price_sum, {r('price_mean', 2)} AS price_mean,
{r('price_min', 2)} AS price_min, {r('price_max', 2)} AS price_max, {r('price_std', 2)} AS price_std,
{r('price_p10', 2)} AS price_p10, {r('price_p90', 2)} AS price_p90, {r('qty_mean')} AS qty_mean, {r('qty_p90')} AS qty_p90,
coalesce(n_obs_qty, 0) AS n_obs_qty, {r('valid_frac_qty')} AS valid_frac_qty FROM s LEFT JOIN g USING (series, date)""")
def c9(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), "l_shipdate", "l_extendedprice",
                                            "l_quantity")
    s = rs.daily_stats(d, "l_shipdate", _BLOCK, ["series"])
    return s.select("series", "date", *[F.col(n) if f == "count" else rnd(n, 2 if n.startswith("price") else 4).alias(n)
                                        for n, _, f in _BLOCK])


@query("c9_irradiance_day_block", f"""WITH g AS (SELECT event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, sum(value) AS s,
avg(value) AS m, max(value) AS x, stddev_samp(value) AS sd, quantile_cont(value, 0.1) AS p10, count(value) AS n FROM events GROUP BY 1, 2),
{_STEP} SELECT event_type, date, {r('s * med / 3600e6')} AS "P", {r('s * med / 3600e9', 6)} AS "P_kWh", {r('m')} AS "P_mean",
{r('x')} AS "P_max", {r('sd')} AS "P_std", {r('p10')} AS "P_p10", n AS "n_obs_P", CAST(dayofyear(date) AS INTEGER) AS doy,
CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day FROM g JOIN st USING (event_type)""")
def c9_block(spark, sf):
    from ..plans.irradiance_days import irradiance_days
    e = events(spark, sf).select("event_type", F.col("ts").alias("time_utc"), F.col("value").alias("P"))
    d = irradiance_days(e, "time_utc", TYPE)
    return d.select("event_type", "date", rnd("P").alias("P"), rnd("P_kWh", 6).alias("P_kWh"), rnd("P_mean").alias("P_mean"),
                    rnd("P_max").alias("P_max"), rnd("P_std").alias("P_std"), rnd("P_p10").alias("P_p10"), "n_obs_P",
                    "doy", "month", "day")


_TYPICAL = f"""v AS (SELECT event_type, ts, CASE WHEN value > 1 THEN value END AS p FROM events),
g AS (SELECT event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, coalesce(sum(p), 0) AS s, avg(p) AS m, min(p) AS lo, max(p) AS x, stddev_samp(p) AS sd,
quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90, count(p) AS n FROM v GROUP BY 1, 2), {_STEP}"""


def _typical_days(spark, sf):
    """Hours as a file has them: text, with a word for values up to 1, and the model's flag."""
    from ..plans.irradiance_days import typical_year_days
    p = F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("missing")
    return typical_year_days(events(spark, sf).select("event_type", F.col("ts").alias("time_utc"), p.alias("P"), p.alias("G(i)"), F.lit("0").alias("Int")), "time_utc", TYPE)


@query("c9_typical_year_names", f"""WITH {_TYPICAL} SELECT event_type, date, {r('s * med / 3600e6')} AS "P_Wh", {r('s * med / 3600e9', 6)} AS "P_kWh", {r('m')} AS "P_mean_W",
{r('lo')} AS "P_min_W", {r('x')} AS "P_max_W", {r('sd')} AS "P_std_W", {r('p10')} AS "P_p10_W", {r('p90')} AS "P_p90_W", {r('s * med / 3600e6')} AS "Gi_Whm2",
{r('m')} AS "Gi_mean", {r('sd')} AS "Gi_std_Wm2", {r('p10')} AS "Gi_p10_Wm2", n AS "n_obs_P" FROM g JOIN st USING (event_type)""")
def c9_typical(spark, sf):
    d = _typical_days(spark, sf)
    gi = {"G(i)_Whm2": "Gi_Whm2", "G(i)_mean": "Gi_mean", "G(i)_std_Wm2": "Gi_std_Wm2", "G(i)_p10_Wm2": "Gi_p10_Wm2"}
    own = ["P_Wh", "P_mean_W", "P_min_W", "P_max_W", "P_std_W", "P_p10_W", "P_p90_W"]
    return d.select("event_type", "date", *[rnd(c).alias(c) for c in own], rnd("P_kWh", 6).alias("P_kWh"),
                    *[rnd(F.col(f"`{c}`")).alias(n) for c, n in gi.items()], "n_obs_P")


@query("c9_f4_typical_year_scaled", f"""WITH {_TYPICAL}, o AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS y FROM events GROUP BY 1), ref AS (SELECT min(y) AS lo, max(y) AS hi FROM o)
SELECT event_type, date, {r('(s * med / 3600e6 - ref.lo) / (ref.hi - ref.lo)', 6)} AS "P_Wh", {r('(s * med / 3600e6 - ref.lo) / (ref.hi - ref.lo)', 6)} AS "P_kWh",
{r('(m * n - ref.lo) / (ref.hi - ref.lo)', 6)} AS "P_mean_W" FROM g JOIN st USING (event_type), ref""")
def c9_f4(spark, sf):
    """Typical-year days scaled by the range of measured days: the block's own names are what the scaling reads."""
    from ..operators import scaling as sc
    days = events(spark, sf).groupBy(F.col("ts").cast("date").alias("ds")).agg(F.sum("value").alias("y"))
    d = sc.minmax_by_ref(_typical_days(spark, sf), ["P_Wh", "P_mean_W"], sc.ref_stats(days, "y", unit="wh"), suffix="_s")
    return d.select("event_type", "date", *[rnd(f"{c}_s", 6).alias(c) for c in ("P_Wh", "P_kWh", "P_mean_W")])


@query("c9_percentiles_only", f"""WITH g AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
quantile_cont(l_extendedprice, 0.1) AS price_p10, quantile_cont(l_quantity, 0.9) AS qty_p90 FROM lineitem GROUP BY 1, 2)
SELECT series, date, {r('price_p10', 2)} AS price_p10, {r('qty_p90')} AS qty_p90 FROM g""")
def c9_percentiles(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), "l_shipdate", "l_extendedprice", "l_quantity")
    s = rs.daily_stats(d, "l_shipdate", [("price_p10", "l_extendedprice", "p10"), ("qty_p90", "l_quantity", "p90")], ["series"], full=False)
    return s.select("series", "date", rnd("price_p10", 2).alias("price_p10"), rnd("qty_p90").alias("qty_p90"))


@query("c9_day_energies", f"""WITH g AS (SELECT event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, sum(value) AS s FROM events GROUP BY 1, 2), {_STEP}
SELECT event_type, date, {r('s * med / 3600e9', 6)} AS "E_day_kWh", {r('2 * s * med / 3600e9', 6)} AS "Hpoa_day_kWhm2",
{r('2 * s * med / 3600e6')} AS "Gi_Whm2" FROM g JOIN st USING (event_type)""")
def c9_energies(spark, sf):
    from ..plans.irradiance_days import irradiance_days
    e = events(spark, sf).select("event_type", F.col("ts").alias("time_utc"), F.col("value").alias("P"), (2 * F.col("value")).alias("G(i)"))
    d = irradiance_days(e, "time_utc", TYPE)
    return d.select("event_type", "date", rnd("E_day_kWh", 6).alias("E_day_kWh"), rnd("Hpoa_day_kWhm2", 6).alias("Hpoa_day_kWhm2"),
                    rnd(F.col("`G(i)_Whm2`")).alias("Gi_Whm2"))


def _wind(spark, sf):
    deg = F.col("value") * 37 - F.floor(F.col("value") * 37 / 360) * 360
    return events(spark, sf).select("event_type", "ts", deg.alias("wd"), "value")


_W = """w AS (SELECT event_type, ts, CAST(ts AS DATE) AS date, value * 37 - floor(value * 37 / 360) * 360 AS wd, value FROM events),
g AS (SELECT event_type, date, sum(value * sin(radians(wd))) AS y, sum(value * cos(radians(wd))) AS x, sum(value) AS w FROM w GROUP BY 1, 2),
u AS (SELECT event_type, date, sum(sin(radians(wd))) AS y, sum(cos(radians(wd))) AS x, count(wd) AS w FROM w GROUP BY 1, 2)"""


@query("c10_circular_mean", f"""WITH {_W} SELECT g.event_type, g.date,
{r('(degrees(atan2(g.y, g.x)) + 360) - floor((degrees(atan2(g.y, g.x)) + 360) / 360) * 360')} AS weighted,
{r('(degrees(atan2(u.y, u.x)) + 360) - floor((degrees(atan2(u.y, u.x)) + 360) / 360) * 360')} AS plain
FROM g JOIN u USING (event_type, date)""")
def c10(spark, sf):
    from ..functions.circular import circular_mean
    d, w = F.col("wd"), F.col("value")
    return _wind(spark, sf).groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(
        rnd(circular_mean(d, w)).alias("weighted"), rnd(circular_mean(d)).alias("plain"))


@query("c11_circular_std", f"""WITH {_W} SELECT g.event_type, g.date,
{r('degrees(sqrt(-2 * ln(least(greatest(sqrt(g.x * g.x + g.y * g.y) / g.w, 1e-12), 1.0))))')} AS weighted,
{r('degrees(sqrt(-2 * ln(least(greatest(sqrt(u.x * u.x + u.y * u.y) / u.w, 1e-12), 1.0))))')} AS plain
FROM g JOIN u USING (event_type, date)""")
def c11(spark, sf):
    from ..functions.circular import circular_std
    d, w = F.col("wd"), F.col("value")
    return _wind(spark, sf).groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(
        rnd(circular_std(d, w)).alias("weighted"), rnd(circular_std(d)).alias("plain"))


@query("c12_dominant_sector", f"""WITH {_W}, s AS (SELECT event_type, date, CAST(floor((wd + 22.5) / 45) AS INTEGER) % 8 AS s,
count(*) AS n, min(ts) AS t FROM w GROUP BY 1, 2, 3)
SELECT event_type, date, ['N','NE','E','SE','S','SW','W','NW'][s + 1] AS wd_mode_sector FROM s
QUALIFY row_number() OVER (PARTITION BY event_type, date ORDER BY n DESC, t) = 1""")
def c12(spark, sf):
    return rs.mode_sector(_wind(spark, sf), "ts", "wd", TYPE)


@query("c13_coverage", f"""SELECT event_type, CAST(ts AS DATE) AS date, count(CASE WHEN value > 1 THEN 1 END) AS n_obs_v,
{r('count(CASE WHEN value > 1 THEN 1 END) / count(*)')} AS valid_frac_v FROM events GROUP BY 1, 2""")
def c13(spark, sf):
    e = events(spark, sf).select("event_type", "ts", F.when(F.col("value") > 1, F.col("value")).alias("v"))
    return rs.coverage(e, "ts", ["v"], TYPE).select("event_type", "date", "n_obs_v", rnd("valid_frac_v").alias("valid_frac_v"))


@query("c14_energy_total", f"""WITH {ED} SELECT series, min(ds) AS forecast_start, max(ds) AS forecast_end, count(y) AS days_counted,
{r('sum(y)', 2)} AS total_wh FROM ed GROUP BY 1""")
def c14(spark, sf):
    d = rs.energy_total(event_days(spark, sf), "ds", "y", ["series"])
    return d.withColumn("total_wh", rnd("total_wh", 2))


@query("c15_group_mean_on_rows", f"WITH {EH} SELECT event_type, ts, {r('avg(value) OVER (PARTITION BY event_type, hour(ts))')} AS hour_mean FROM eh")
def c15(spark, sf):
    d = rs.group_mean(event_hours(spark, sf), "value", ["event_type", F.hour("ts")], "m")
    return d.select("event_type", "ts", rnd("m").alias("hour_mean"))


@query("c16_reconcile", f"""SELECT event_type, CAST(ts AS DATE) AS ds, {r('sum(value)')} AS raw_sum,
{r('sum(value) + CASE WHEN day(CAST(ts AS DATE)) = 7 THEN 1 ELSE 0 END')} AS daily_sum, day(CAST(ts AS DATE)) <> 7 AS matches FROM events GROUP BY 1, 2""")
def c16(spark, sf):
    """Day sums against the raw rows; the seventh of each month has been altered."""
    e = events(spark, sf)
    daily = rs.daily_energy(e.select("event_type", "ts", "value"), "ts", ["value"], by=TYPE).withColumnRenamed("ts", "ds")
    daily = daily.withColumn("value", F.col("value") + F.when(F.day("ds") == 7, 1.0).otherwise(0.0))
    d = rs.reconcile(e, daily, "ts", "value", "ds", "value", TYPE)
    return d.select("event_type", "ds", rnd("raw_sum").alias("raw_sum"), rnd("daily_sum").alias("daily_sum"), "matches")
