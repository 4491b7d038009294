"""Profiles (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from ..session import scratch_path
from .base import AOD, all_order_days, events, query, r, rnd, table

_STATS = ("mean", "median", "std", "min", "25%", "75%", "max", "sum", "skew", "kurtosis")


def _num_sql(t: str, col: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}'{col}' AS variable, 'numeric' AS type, count(*) AS count, count({col}) AS non_null, count(*) - count({col}) AS missing_count,
{r(f'avg({col})', 3)} AS mean, {r(f'quantile_cont({col}, 0.5)', 3)} AS median, {r(f'stddev_samp({col})', 3)} AS std, {r(f'min({col})', 3)} AS min,
{r(f'quantile_cont({col}, 0.25)', 3)} AS "25%", {r(f'quantile_cont({col}, 0.75)', 3)} AS "75%", {r(f'max({col})', 3)} AS max, {r(f'sum({col})', 1)} AS sum,
{r(f'skewness({col})', 3)} AS skew, {r(f'kurtosis({col})', 3)} AS kurtosis FROM {t}""" + (f" GROUP BY {group}" if group else "")


def _num(d, keys=()):
    return d.select(*keys, "variable", "type", "count", "non_null", "missing_count",
                    *[rnd(F.col(f"`{c}`"), 1 if c == "sum" else 3).alias(c) for c in _STATS])


@query("i1_numeric_profile", " UNION ALL ".join([_num_sql("orders", "o_totalprice"), _num_sql("orders", "o_custkey"),
                                                 _num_sql("(SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS gaps FROM orders)", "gaps")]))
def i1(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", "o_custkey",
                                          F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("gaps"))
    return _num(pr.profile_numeric(o))


@query("i1_numeric_profile_documents", " UNION ALL ".join([_num_sql("documents", "n_chars", "lang")]))
def i1_docs(spark, sf):
    d = table(spark, sf, "documents").select("lang", "n_chars")
    return _num(pr.profile_numeric(d, ["n_chars"], ["lang"]), ["lang"])


def _cat_sql(t, col):
    return f"""SELECT '{col}' AS variable, 'categorical' AS type, (SELECT count(DISTINCT {col}) FROM {t}) AS unique_count, {col} AS top, n AS freq
FROM (SELECT {col}, count(*) AS n FROM {t} WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("i2_categorical_profile", " UNION ALL ".join(f"({_cat_sql(t, c)})" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"))))
def i2(spark, sf):
    return pr.profile_categorical(table(spark, sf, "orders"))


@query("i2_categorical_profile_events", " UNION ALL ".join(f"({_cat_sql(t, c)})" for t, c in (("events", "event_type"), ("events", "props"))))
def i2_events(spark, sf):
    return pr.profile_categorical(events(spark, sf))


@query("i2_categorical_profile_documents", " UNION ALL ".join(f"({_cat_sql('documents', c)})" for c in ("text", "lang", "source")))
def i2_documents(spark, sf):
    """Whole texts as categories: counted by digest, read again only for the winners."""
    return pr.profile_categorical(table(spark, sf, "documents").select("text", "lang", "source"))


@query("i3_time_profile", f"""WITH g AS (SELECT event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events)
SELECT event_type, 'ts' AS date_column, min(ts) AS start, max(ts) AS "end", CAST(NULL AS VARCHAR) AS inferred_freq, {r('quantile_cont(g, 0.5) / 1e6')} AS median_delta_seconds
FROM g GROUP BY 1""")
def i3(spark, sf):
    return pr.profile_time(events(spark, sf), "ts", ["event_type"]).withColumn("median_delta_seconds", rnd("median_delta_seconds"))


@query("i3_time_profile_regular", f"""WITH {AOD} SELECT 'ds' AS date_column, min(ds) AS start, max(ds) AS "end", 'day' AS inferred_freq,
CAST(NULL AS DOUBLE) AS median_delta_seconds FROM aod""")
def i3_days(spark, sf):
    from ..operators.resample import complete
    return pr.profile_time(complete(all_order_days(spark, sf), "ds", "day"), "ds")


@query("i4_folder_profile", f"""WITH n AS ({_num_sql('events', 'value', 'event_type')} UNION ALL {_num_sql('events', 'user_id', 'event_type')}),
p AS (SELECT event_type, props, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, 'props' AS variable, count(*) AS unique_count, arg_min(props, (-n, props)) AS top, max(n) AS freq FROM p GROUP BY 1),
t AS (SELECT event_type, min(ts) AS start, max(ts) AS "end" FROM events GROUP BY 1)
SELECT 'event_type=' || event_type AS file, variable, type, mean, median, skew, CAST(NULL AS DOUBLE) AS unique_count, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS DOUBLE) AS freq, start, "end" FROM n JOIN t USING (event_type)
UNION ALL SELECT 'event_type=' || event_type, variable, 'categorical', NULL, NULL, NULL, CAST(unique_count AS DOUBLE), top, CAST(freq AS DOUBLE), start, "end" FROM c JOIN t USING (event_type)""")
def i4(spark, sf):
    path = scratch_path(spark, "folder")
    e = events(spark, sf).select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value", "user_id", "props")
    e.write.partitionBy("event_type").option("header", "true").csv(path)
    from ..sources.readers import union_folder
    d = union_folder(spark, path, clean=False, recursive=True, with_file=True)
    num = pr.infer_numeric(d, ["value", "user_id", "props"])
    from ..functions.cells import to_number
    from ..functions.times import parse_time
    d = d.select(parse_time(F.col("ts")).alias("ts"), *[to_number(F.col(c)).alias(c) for c in num], "props",
                 F.regexp_extract("file", "(event_type=[^/]+)", 1).alias("file"))
    out = pr.profile_files(d, "ts", "file", num)
    return out.select("file", "variable", "type", *[rnd(c, 3).alias(c) for c in ("mean", "median", "skew")],
                      F.col("unique_count").cast("double").alias("unique_count"), "top", F.col("freq").cast("double").alias("freq"), "start", "end")


@query("i5_missing_counts", "SELECT 'o_totalprice' AS variable, count(*) - count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS missing_count FROM orders UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey) FROM orders")
def i5(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("o_totalprice"))
    return pr.missing_counts(o)
