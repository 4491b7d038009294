"""Cell typing, coercion, projection, de-duplication, timestamp repair (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import date_from_parts, date_from_stamp, date_text, parse_time
from ..operators import clean
from .base import events, query, r, rnd, table


def _cells(spark, sf):
    """Events as the text cells a logger would write."""
    i = F.col("event_id")
    k = F.pmod(i, F.lit(7))
    thousands = F.concat((i + 1000000).cast("string").substr(1, 4), F.lit(","),
                         (i + 1000000).cast("string").substr(5, 10))
    cell = (F.when(k == 0, F.lit("  ")).when(k == 1, thousands)
            .when(k == 2, F.col("value").cast("decimal(18,2)").cast("string"))
            .when(k == 3, F.date_format("ts", "yyyy-MM-dd"))
            .when(k == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(k == 5, F.lit("X")).otherwise(F.col("event_type")))
    return events(spark, sf).select("event_id", "ts", "value", cell.alias("cell"))


_CELLS = """c AS (SELECT event_id, ts, value, event_id % 7 AS k, event_type,
CASE event_id % 7 WHEN 0 THEN '  '
  WHEN 1 THEN substr(CAST(event_id + 1000000 AS VARCHAR), 1, 4) || ',' || substr(CAST(event_id + 1000000 AS VARCHAR), 5)
  WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 3 THEN strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN 'X' ELSE event_type END AS cell FROM events)"""


@query("b1_cell_typing", f"""WITH {_CELLS} SELECT event_id,
CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'date'
  WHEN 4 THEN CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN 'date' ELSE 'time' END ELSE 'text' END AS kind,
CASE k WHEN 0 THEN '' WHEN 1 THEN CAST(event_id + 1000000 AS VARCHAR) WHEN 2 THEN CAST(CAST(cell AS DOUBLE) AS VARCHAR)
  WHEN 4 THEN CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN strftime(ts, '%Y-%m-%d') ELSE cell END
  ELSE cell END AS text FROM c""")
def b1(spark, sf):
    return clean.type_cells(_cells(spark, sf), ["cell"]).select("event_id", "cell.*")


@query("b2_numeric_coercion", f"""WITH {_CELLS} SELECT event_id, TRY_CAST(cell AS DOUBLE) AS cell,
CAST(NULL AS DOUBLE) AS nan_text FROM c""")
def b2(spark, sf):
    d = _cells(spark, sf).select("event_id", "cell", F.lit("nan").alias("nan_text"))
    return clean.to_numeric(d, ["cell", "nan_text"])


@query("b3_sentinels_to_missing", f"""WITH {_CELLS} SELECT event_id,
CASE WHEN trim(cell) IN ('X', '') THEN NULL ELSE trim(cell) END AS cell FROM c""")
def b3(spark, sf):
    d = _cells(spark, sf).select("event_id", F.trim("cell").alias("cell"))
    return clean.replace_sentinels(d, ["X", ""], ["cell"])


@query("b4_time_parsing", """SELECT event_id, CASE event_id % 7
WHEN 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('minute', ts)
WHEN 6 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""")
def b4(spark, sf):
    k, fmt = F.pmod("event_id", F.lit(7)), F.date_format
    epoch = (F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400 + F.hour("ts") * 3600
             + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("string")
    text = (F.when(k == 0, fmt("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, epoch)
            .when(k == 2, fmt("ts", "yyyy/M/d H:mm:ss")).when(k == 3, fmt("ts", "yyyy-MM-dd"))
            .when(k == 4, fmt("ts", "M/d/yyyy H:mm")).when(k == 5, fmt("ts", "yyyyMMdd:HHmm")).otherwise(F.lit("soon")))
    return events(spark, sf).select("event_id", parse_time(text).alias("parsed"))


@query("b5_time_column_by_name", """SELECT 'LocalTime' AS by_name, 'o_orderdate' AS by_type, 'date_text' AS by_share,
count(*) AS rows FROM orders""")
def b5(spark, sf):
    o = table(spark, sf, "orders")
    renamed = o.select("o_orderkey", F.col("o_orderdate").alias("LocalTime"))
    as_text = o.select("o_totalprice", F.col("o_orderpriority").alias("time_text"),
                       F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"))
    return o.agg(F.lit(clean.find_time_column(renamed)).alias("by_name"),
                 F.lit(clean.detect_time_column(o)).alias("by_type"),
                 F.lit(clean.detect_time_column(as_text)).alias("by_share"),
                 F.count(F.lit(1)).alias("rows"))


@query("b6_mode_year", """WITH n AS (SELECT o_orderpriority AS series, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT series, CAST(y AS INTEGER) AS mode_year FROM n
QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, y) = 1""")
def b6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderdate")
    return clean.mode_year(o, "o_orderdate", ["series"])


def _broken(spark, sf):
    """Event times with runs of times a century late and times that could not be read."""
    run = F.pmod(F.floor(F.col("event_id") / 40), F.lit(6)) == 0
    late = F.col("ts") + F.make_ym_interval(F.lit(100))
    t = (F.when(run & (F.pmod("event_id", F.lit(3)) == 0), F.lit(None).cast("timestamp_ntz"))
         .when(run, late).when(F.pmod("event_id", F.lit(89)).isin(5, 6), F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.col("ts")))
    return events(spark, sf).select("event_id", "event_type", t.alias("t"))


def _repair_sql(by: str | None, tail: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    and_by = f"{by}, " if by else ""
    year = (f"(SELECT y FROM yr WHERE yr.{by} = f.{by} ORDER BY n DESC, y LIMIT 1)" if by
            else "(SELECT y FROM yr ORDER BY n DESC, y LIMIT 1)")
    return f"""WITH s AS (SELECT event_id, event_type, CASE
  WHEN (event_id // 40) % 6 = 0 AND event_id % 3 = 0 THEN NULL WHEN (event_id // 40) % 6 = 0 THEN ts + INTERVAL 100 YEAR
  WHEN event_id % 89 IN (5, 6) THEN NULL ELSE ts END AS t FROM events),
yr AS (SELECT {and_by} year(t) AS y, count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY ALL),
a AS (SELECT *, (t IS NULL OR year(t) > 2060) AS bad, row_number() OVER ({part} ORDER BY event_id) AS rn FROM s),
b AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER ({part} ORDER BY event_id) AS grp FROM a),
f AS (SELECT *, max(CASE WHEN NOT bad THEN t END) OVER (PARTITION BY {and_by} grp) AS good,
  first_value(t) OVER w AS o, row_number() OVER w - 1 AS off,
  last_value(CASE WHEN t IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS prn, last_value(t IGNORE NULLS) OVER w AS pt
  FROM b WINDOW w AS (PARTITION BY {and_by} grp, bad ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(good + INTERVAL 1 MINUTE, make_timestamp({year}, 1, 1, 0, 0, 0)) AS base FROM f),
fixed AS (SELECT event_id, event_type, t, CASE WHEN NOT bad THEN t
  WHEN o IS NOT NULL THEN base + (pt - o) + CAST(rn - prn AS INTEGER) * INTERVAL 1 MINUTE
  ELSE base + CAST(off AS INTEGER) * INTERVAL 1 MINUTE END AS fixed_time FROM g)
{tail}"""


@query("b7_timestamp_repair", _repair_sql(None, "SELECT event_id, fixed_time FROM fixed"))
def b7(spark, sf):
    return clean.repair_timestamps(_broken(spark, sf), "t", "event_id").select("event_id", "fixed_time")


@query("b7_timestamp_repair_by_series", _repair_sql("event_type", "SELECT event_id, event_type, fixed_time FROM fixed"))
def b7_by(spark, sf):
    return clean.repair_timestamps(_broken(spark, sf), "t", "event_id", ["event_type"]).select(
        "event_id", "event_type", "fixed_time")


@query("b8_repair_log", _repair_sql(None, """SELECT event_id, strftime(t, '%Y-%m-%d') AS original_text, fixed_time FROM fixed
WHERE t IS DISTINCT FROM fixed_time"""))
def b8(spark, sf):
    d = _broken(spark, sf).withColumn("t_text", date_text(F.col("t")))
    return clean.repair_log(clean.repair_timestamps(d, "t", "event_id"), "t_text", "t").select(
        "event_id", "original_text", "fixed_time")


@query("b9_b11_rename_keep_drop", "SELECT event_id, value AS \"Wh\", ts AS \"Date\" FROM events")
def b9(spark, sf):
    d = clean.rename_ci(clean.rename_ci(events(spark, sf), "VALUE", "Wh"), "TS", "Date")
    d = clean.drop(d, ["props", "user_id", "not_there"])
    return clean.keep(d, ["event_id", "Wh", "missing", "Date"])


@query("b12_drop_empty_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def b12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(None).cast("double").alias("empty"))
    return clean.drop_empty_columns(o)


@query("b13_drop_missing_rows", "SELECT event_id, CASE WHEN value > 100 THEN value END AS big FROM events WHERE value > 1")
def b13(spark, sf):
    d = events(spark, sf).select("event_id", F.when(F.col("value") > 1, F.col("ts")).alias("t"),
                                 F.when(F.col("value") > 100, F.col("value")).alias("big"))
    return clean.dropna(clean.dropna(d, ["t"]), how="all").select("event_id", "big")


def _day_rows(spark, sf):
    return events(spark, sf).select("event_type", F.col("ts").cast("date").alias("day"), "event_id", "value")


@query("b14_dedupe_keep_last", """SELECT event_type, CAST(ts AS DATE) AS day, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""")
def b14_last(spark, sf):
    return clean.dedupe(_day_rows(spark, sf), ["event_type", "day"], ["event_id"], "last")


@query("b14_dedupe_keep_first", """SELECT event_type, CAST(ts AS DATE) AS day, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) = 1""")
def b14_first(spark, sf):
    return clean.dedupe(_day_rows(spark, sf), ["event_type", "day"], ["event_id"], "first")


@query("b15_closed_range", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-04-23' AND TIMESTAMP '1998-02-04'""")
def b15(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("1997-04-23", "1998-02-04"))
    return clean.between(table(spark, sf, "orders"), "o_orderdate", lo, hi).select("o_orderkey", "o_totalprice")


@query("b16_dates_from_parts", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_parts,
CAST(o_orderdate AS DATE) AS from_stamp, CAST(NULL AS DATE) AS impossible FROM orders""")
def b16(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", date_from_parts(F.year(d), F.month(d), F.day(d).cast("string")).alias("from_parts"),
        date_from_stamp(F.date_format(d, "yyyyMMddHH")).alias("from_stamp"),
        date_from_parts(F.year(d), F.lit(2), F.lit(30)).alias("impossible"))


@query("b17_date_text", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date_text FROM events")
def b17(spark, sf):
    return events(spark, sf).select("event_id", date_text(F.col("ts")).alias("date_text"))


@query("b18_value_column", f"""SELECT 'Wh_pred' AS named, 'o_orderkey' AS first_numeric, {r('sum(o_totalprice)', 2)} AS total FROM orders""")
def b18(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(F.col("o_totalprice").alias("Wh"), F.col("o_totalprice").alias("Wh_pred"))
    c = clean.pick_value_column(p)
    return p.agg(F.lit(c).alias("named"), F.lit(clean.pick_value_column(o)).alias("first_numeric"),
                 rnd(F.sum(c), 2).alias("total"))
