"""Registry of queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import complete, resample
from ..session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under a name, with its SQL."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nudge(d: int) -> float:
    return 3.0 * 10.0 ** -(d + 4)


def rnd(c, d: int = 4) -> Column:
    """Round half up on both engines: a nudge far below the last digit settles exact ties."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(_nudge(d)), d) + F.lit(0.0)


def r(expr: str, d: int = 4) -> str:
    """SQL form of :func:`rnd`."""
    return f"(round(({expr}) + {_nudge(d):.12f}, {d}) + 0.0::DOUBLE)"


# ---- shared inputs, Spark side -------------------------------------------------------------

def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def event_hours(spark, sf, full: bool = True) -> DataFrame:
    """Hourly mean of value per event type."""
    return resample(events(spark, sf).select("event_type", "ts", "value"), "ts", "hour",
                    {"value": "mean"}, ["event_type"], full)


def event_days(spark, sf) -> DataFrame:
    """Daily sum of value per event type as (series, ds, y)."""
    d = resample(events(spark, sf).select("event_type", "ts", "value"), "ts", "day", {"value": "sum"},
                 ["event_type"])
    return d.select(F.col("event_type").alias("series"), F.col("ts").alias("ds"), F.col("value").alias("y"))


def order_days(spark, sf, full: bool = True) -> DataFrame:
    """Daily order totals per priority as (series, ds, y); days without orders have no y."""
    d = (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"),
                                            F.col("o_orderdate").cast("date").alias("ds"))
         .agg(F.sum("o_totalprice").alias("y")))
    return complete(d, "ds", "day", ["series"]) if full else d


def order_days_filled(spark, sf) -> DataFrame:
    from ..operators.features import fill
    return fill(order_days(spark, sf), ["y"], "ds", ["series"])


def stored_order_days(spark, sf) -> DataFrame:
    """The filled daily table, written to the shared folder: for queries that read it more than once."""
    return cut_lineage(order_days_filled(spark, sf))


def all_order_days(spark, sf) -> DataFrame:
    """Daily order totals over everything as (ds, y)."""
    return (table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds"))
            .agg(F.sum("o_totalprice").alias("y")))


def line_days(spark, sf) -> DataFrame:
    """Daily lineitem measures as (ds, qty, price, disc)."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ds"))
            .agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
                 F.avg("l_discount").alias("disc")))


# ---- shared inputs, SQL side ---------------------------------------------------------------

EH = """eh0 AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
ehs AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM eh0 GROUP BY 1),
eh AS (SELECT s.event_type, s.ts, h.value FROM ehs s LEFT JOIN eh0 h USING (event_type, ts))"""
ED = """ed0 AS (SELECT event_type AS series, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1, 2),
eds AS (SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM ed0 GROUP BY 1),
ed AS (SELECT s.series, s.ds, coalesce(e.y, 0) AS y FROM eds s LEFT JOIN ed0 e USING (series, ds))"""
OD0 = """od0 AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y
FROM orders GROUP BY 1, 2)"""
OD = OD0 + """,
ods AS (SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM od0 GROUP BY 1),
od AS (SELECT s.series, s.ds, o.y FROM ods s LEFT JOIN od0 o USING (series, ds))"""
ODF = OD + """,
odf AS (SELECT series, ds, coalesce(
  last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
  FROM od)"""
AOD = "aod AS (SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1)"
LD = """ld AS (SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
avg(l_discount) AS disc FROM lineitem GROUP BY 1)"""
