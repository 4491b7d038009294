"""Readers and sinks (A): each query writes the given tables out as the files in question and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sources as src
from ..session import scratch_path, union_all
from .base import AOD, all_order_days, events, query, r, rnd, table

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text_events(spark, sf):
    return events(spark, sf).select("event_id", F.date_format("ts", _STAMP).alias("LocalTime"), "event_type", "value")


@query("a1_csv_scan_with_bom", "SELECT event_id, ts AS \"LocalTime\", event_type, value FROM events")
def a1(spark, sf):
    path = scratch_path(spark, "bom")
    _text_events(spark, sf).withColumnRenamed("event_id", "﻿event_id").write.option("header", "true").csv(path)
    schema = "`﻿event_id` bigint, LocalTime timestamp_ntz, event_type string, value double"
    return src.read_csv(spark, path, schema, timestampNTZFormat=_STAMP)


@query("a2_repeated_headers", f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"LocalTime\", {r('value')} AS \"W\" FROM events")
def a2(spark, sf):
    path = scratch_path(spark, "headers")
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("value").cast("string"))
    # the logger starts again every thousand rows and writes its header once more
    lines = F.when(F.pmod("event_id", F.lit(1000)) == 500, F.array(F.lit("LocalTime,W"), line)).otherwise(F.array(line))
    events(spark, sf).select(F.explode(lines).alias("value")).write.text(path)
    d = spark.read.schema("LocalTime string, W string").csv(path)
    return src.drop_repeated_headers(d).select("LocalTime", rnd(F.col("W").cast("double")).alias("W"))


# Text that stands around the data in irradiance-model files.
_BEFORE = ["Latitude (decimal degrees):\t24.148", "Longitude (decimal degrees):\t120.703", "Elevation (m):\t87", "",
           "month,year", *[f"{m},{2004 + (m * 7) % 13}" for m in range(1, 13)]]
_AFTER = ["", "P: PV system power (W)", "T2m: 2-m air temperature (degree Celsius)", "(c) European Union, 2001-2025"]


def _preamble_files(spark, sf):
    """Per event type one file: preamble, header, data and footer.  Types whose names end in a vowel or k have their columns in another order."""
    path = scratch_path(spark, "preamble")
    e = events(spark, sf)
    other = F.col("event_type").rlike("[aeiouk]$")
    cells = [F.date_format("ts", "yyyyMMdd:HHmm"), F.col("value").cast("string"), F.col("user_id").cast("string")]
    data = e.select("event_type", F.lit(1).alias("at"), F.when(other, F.concat_ws(",", cells[0], cells[2], F.lit("0"), cells[1])).otherwise(F.concat_ws(",", *cells)).alias("value"))
    kinds = e.select("event_type").distinct()
    lines = F.concat(F.array(*[F.struct(F.lit(0).alias("at"), F.lit(x).alias("value")) for x in _BEFORE]),
                     F.array(F.struct(F.lit(0).alias("at"), F.when(other, "time,T2m,Int,P").otherwise("time,P,T2m").alias("value"))),
                     F.array(*[F.struct(F.lit(2).alias("at"), F.lit(x).alias("value")) for x in _AFTER]))
    text = union_all([data, kinds.select("event_type", F.posexplode(lines)).select("event_type", "col.*", "pos").drop("pos")], allow_missing=True)
    (text.withColumn("n", F.monotonically_increasing_id()).repartition("event_type").sortWithinPartitions("event_type", "at", "n")
     .drop("at", "n").write.partitionBy("event_type").text(path))
    return path


@query("a3_preamble_csv", f"SELECT event_type, date_trunc('minute', ts) AS time, {r('value')} AS \"P\", user_id AS \"T2m\" FROM events")
def a3(spark, sf):
    from ..functions.times import parse_time
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("P", T.DoubleType()), T.StructField("T2m", T.LongType())])
    d = src.read_preamble_csv(spark, _preamble_files(spark, sf), schema)
    return d.select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), parse_time(F.col("time")).alias("time"),
                    rnd("P").alias("P"), "T2m")


@query("a4_preamble_metadata", """SELECT event_type, 24.148::DOUBLE AS latitude, 120.703::DOUBLE AS longitude, CAST(12 AS INTEGER) AS months,
CAST(2004 + 7 AS INTEGER) AS january, CAST(2004 AS INTEGER) + CAST((12 * 7) % 13 AS INTEGER) AS december FROM events GROUP BY 1""")
def a4(spark, sf):
    m = src.read_preamble_meta(spark, _preamble_files(spark, sf)).where("latitude IS NOT NULL")
    return m.select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), "latitude", "longitude",
                    F.size("years").alias("months"), F.col("years")[1].alias("january"), F.col("years")[12].alias("december"))


@query("a5_monthly_files", f"""WITH {AOD} SELECT ds AS "Date", CAST(year(ds) AS INTEGER) AS "Year", CAST(month(ds) AS INTEGER) AS "Month",
CAST(day(ds) AS INTEGER) AS "Day", strftime(ds, '%d') AS "ObsTime", {r('y', 2)} AS total,
CASE WHEN year(ds) >= 1998 THEN strftime(ds, '%j') END AS "Extra" FROM aod""")
def a5(spark, sf):
    path = scratch_path(spark, "months")
    d = all_order_days(spark, sf)
    late = F.year("ds") >= 1998
    line = F.concat_ws(",", F.day("ds").cast("string"), F.round("y", 2).cast("decimal(18,2)").cast("string"),
                       F.when(late, F.date_format("ds", "DDD")))
    # a month is one small file: two header lines, then at most 31 days
    rows = F.array_sort(F.collect_list(F.struct("ds", line.alias("line"))))
    head = F.when(F.year("m") >= 1998, "觀測時間,總計,其他\nObsTime,total,Extra").otherwise("觀測時間,總計\nObsTime,total")
    mark = F.when(F.month("m") == 3, " (1)").otherwise("")
    name = F.concat(F.lit("467490-"), F.date_format("m", "yyyy-MM"), mark, F.lit(".csv"))
    (d.groupBy(F.trunc("ds", "month").alias("m")).agg(rows.alias("rows"))
     .select(name.alias("month"), F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("value"))
     .write.partitionBy("month").text(path))
    out = src.read_monthly_files(spark, path)
    return out.select("Date", "Year", "Month", "Day", "ObsTime", rnd(F.col("total").cast("double"), 2).alias("total"), "Extra")


@query("a6_folder_union_clean_names", f"""SELECT o_orderkey AS "order_key", {r('o_totalprice', 2)} AS "total_kWh", o_orderstatus AS "status" FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, {r('o_totalprice', 2)}, NULL FROM orders WHERE o_orderstatus = 'P'""")
def a6(spark, sf):
    path = scratch_path(spark, "union")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" order key"), F.col("o_totalprice").alias("total（kWh）, net"),
                                          F.col("o_orderstatus").alias("status "))
    w = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    o.where("`status ` <> 'P'").write.options(**w).csv(path)
    o.where("`status ` = 'P'").drop("status ").write.mode("append").options(**w).csv(path)
    d = src.union_folder(spark, path)
    return d.select(F.col("order_key").cast("bigint").alias("order_key"), rnd(F.col("`total_kWh,_net`").cast("double"), 2).alias("total_kWh"), "status")


@query("a7_latest_file", f"SELECT 2 AS run, {r('sum(o_totalprice)', 2)} AS total FROM orders")
def a7(spark, sf):
    path = scratch_path(spark, "runs")
    total = table(spark, sf, "orders").agg(F.sum("o_totalprice").alias("total"))
    for run in (1, 2):
        total.select(F.lit(run).alias("run"), (F.col("total") * run / 2).alias("total")).write.json(f"{path}/run-{run}")
    newest = src.latest_file(spark, path, "*.json")
    d = spark.read.schema("run int, total double").json(newest)
    return d.select("run", rnd("total", 2).alias("total"))


@query("a8_encoding_and_separator", f"SELECT event_id, event_type || ' é' AS label, {r('value')} AS value FROM events")
def a8(spark, sf):
    path = scratch_path(spark, "latin")
    e = events(spark, sf).select("event_id", F.concat("event_type", F.lit(" é")).alias("label"), "value")
    e.write.option("encoding", "ISO-8859-1").csv(path, sep=";")
    opts = src.sniff(spark, path)
    d = spark.read.schema("event_id bigint, label string, value double").options(**opts).csv(path)
    return d.select("event_id", "label", rnd("value").alias("value"))


@query("a8_folder_of_mixed_files", f"""SELECT event_id, event_type || ' é' AS label, {r('value')} AS value FROM events
UNION ALL SELECT NULL, 'a line has more cells than the header', NULL UNION ALL SELECT NULL, 'no header', NULL""")
def a8_mixed(spark, sf):
    """Commas in UTF-8, semicolons in Latin-1, a file of too many cells and one of comments only, in one folder."""
    import warnings
    path = scratch_path(spark, "mixed")
    e = events(spark, sf).select("event_id", F.concat("event_type", F.lit(" é")).alias("label"), "value")
    e.where("event_id % 2 = 0").write.option("header", "true").csv(path)
    e.where("event_id % 2 <> 0").select("value", "event_id", "label").write.mode("append").options(header="true", encoding="ISO-8859-1", sep=";").csv(path)
    last = e.agg(F.max("event_id").cast("string").alias("id"))
    for lines in ([F.lit("event_id,label"), F.concat_ws(",", "id", F.lit("x"), "id")], [F.concat(F.lit("# rows: "), F.col("id"))]):
        last.select(F.explode(F.array(*lines)).alias("value")).coalesce(1).write.mode("append").text(path)
    bad = src.folder_layouts(spark, path).where("reason IS NOT NULL").select(F.lit(None).cast("bigint").alias("event_id"), F.col("reason").alias("label"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        d = src.read_folder_any(spark, path)
    return union_all([d.select(F.col("event_id").cast("bigint").alias("event_id"), "label", rnd(F.col("value").cast("double")).alias("value")), bad], allow_missing=True)


@query("a9_json_of_unknown_nesting", f"""SELECT event_type, date_trunc('hour', ts) AS time_utc, {r('avg(value)')} AS "G(h)" FROM events GROUP BY 1, 2""")
def a9_any(spark, sf):
    """Half of the documents have the table elsewhere and call its time otherwise; nobody tells the reader where."""
    from ..operators.resample import resample
    path = scratch_path(spark, "json")
    h = resample(events(spark, sf).select("event_type", "ts", "value"), "ts", "hour", {"value": "mean"}, ["event_type"], full=False)
    months = F.array(F.struct(F.lit(1).alias("month"), F.lit(2005).alias("year"))).alias("months_selected")
    for odd, time, fmt, wrap in ((0, "time(UTC)", "yyyyMMdd:HHmm", lambda t: F.struct(t.alias("tmy_hourly")).alias("outputs")),
                                 (1, "Date", "yyyy-MM-dd HH:mm:ss", lambda t: F.struct(F.struct(t.alias("rows")).alias("hourly")).alias("data"))):
        rows = F.collect_list(F.struct(F.date_format("ts", fmt).alias(time), F.col("value").alias("G(h)")))
        (h.where(F.day("ts") % 2 == odd).groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(rows.alias("t"))
         .select("event_type", F.struct(months).alias("inputs"), wrap(F.col("t"))).write.mode("append").partitionBy("event_type").json(path))
    d = src.read_hourly_json_any(spark, path, multi_line=False)
    return d.select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), "time_utc", rnd("G(h)").alias("G(h)"))


@query("a9_hourly_json", f"""SELECT event_type, date_trunc('hour', ts) AS time_utc, {r('avg(value)')} AS "G(h)" FROM events GROUP BY 1, 2""")
def a9(spark, sf):
    from ..operators.resample import resample
    path = scratch_path(spark, "json")
    h = resample(events(spark, sf).select("event_type", "ts", "value"), "ts", "hour", {"value": "mean"}, ["event_type"], full=False)
    # one document per type and day keeps each array at 24 rows or fewer
    rows = F.collect_list(F.struct(F.date_format("ts", "yyyyMMdd:HHmm").alias("time(UTC)"), F.col("value").alias("G(h)")))
    (h.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(rows.alias("tmy_hourly"))
     .select("event_type", F.struct(F.lit("site").alias("name")).alias("inputs"), F.struct("tmy_hourly").alias("outputs"))
     .write.partitionBy("event_type").json(path))
    schema = T.StructType([T.StructField("time(UTC)", T.StringType()), T.StructField("G(h)", T.DoubleType())])
    d = src.read_hourly_json(spark, path, "outputs.tmy_hourly", schema, with_file=True, multi_line=False)
    return d.select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), "time_utc", rnd("G(h)").alias("G(h)"))


@query("a10_sinks", f"""SELECT 'csv' AS fmt, count(*) AS n, {r('sum(round(value / 7, 5))', 3)} AS total FROM events
UNION ALL SELECT 'json', count(*), {r('sum(value / 7)', 3)} FROM events UNION ALL SELECT 'parquet', count(*), {r('sum(value / 7)', 3)} FROM events""")
def a10(spark, sf):
    d, parts = events(spark, sf).select("event_id", "event_type", (F.col("value") / 7).alias("v")), []
    for fmt, digits, part in (("csv", 5, ()), ("json", None, ()), ("parquet", None, ("event_type",))):
        path = scratch_path(spark, fmt)
        src.write_table(d, path, fmt, digits, part)
        back = spark.read.format(fmt).schema("event_id bigint, event_type string, v double").options(header="true").load(path)
        one = back.agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n"), rnd(F.sum("v"), 3).alias("total"))
        parts.append(one)
    return union_all(parts)
