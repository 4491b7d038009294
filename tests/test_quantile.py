import random

import numpy as np
import pytest

from heliochron.operators.quantile import exact_percentiles, range_of
from heliochron.operators.resample import daily_stats, step_hours, step_median
from pyspark.sql import functions as F

PS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [None, 0, 100])
def test_against_numpy(spark, small):
    """A hot group of many ranges, small groups, ties and missing values, by either way or both."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 7.0, rng.expovariate(0.01)]), float(rng.randrange(4))) for _ in range(900)]
    rows += [("b", rng.random(), None if i % 3 else 2.5) for i in range(40)] + [("one", 4.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, k double")
    got = {(r.g, r.variable, r.p): r.value for r in exact_percentiles(df, ["x", "k"], PS, ["g"], small).collect()}
    n = 0
    for g in ("hot", "b", "one"):
        for i, c in ((1, "x"), (2, "k")):
            v = [r[i] for r in rows if r[0] == g and r[i] is not None]
            for p in PS if v else []:
                assert got[(g, c, p)] == pytest.approx(np.quantile(v, p), abs=1e-9), (g, c, p)
                n += 1
    assert n == len(got)


def test_ranges_keep_the_order(spark):
    rng = random.Random(9)
    v = sorted([rng.gauss(0, 1) * 10.0 ** rng.randrange(-12, 13) for _ in range(3000)] + [0.0, 1e-320, -1e-320, 1e300, -1e300, 20.0, 20.000001])
    got = [r.r for r in spark.createDataFrame([(x,) for x in v], "v double").select("v", range_of(F.col("v")).alias("r")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_odd_values_in_large_groups(spark):
    v = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1e308, 1.0, float("nan"), 2.0, 2.0]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = {r.p: r.value for r in exact_percentiles(df, ["x"], [0.0, 0.1, 0.2, 0.5, 0.6, 0.9, 1.0], (), 0).collect()}
    assert (got[0.0], got[0.1], got[0.2], got[0.5], got[0.6], got[0.9]) == (float("-inf"), -5e-324, 0.0, 1.0, 2.0, float("inf")) and np.isnan(got[1.0])


def test_a_million_values_within_a_hundredth(spark):
    """One range of the first round; the parts of the second stay small, and so does what is ordered."""
    from heliochron.operators import quantile as q
    n = 1_000_000
    df = spark.range(n).select((F.lit(1.7e9) + F.pmod(F.col("id") * 7919, F.lit(n)) * 17).alias("x"))
    assert [r.value for r in exact_percentiles(df, ["x"], [0.1, 0.5]).orderBy("p").collect()] == pytest.approx([1.7e9 + 17 * 0.1 * (n - 1), 1.7e9 + 17 * 0.5 * (n - 1)], abs=1e-6)
    v = F.col("x")
    sizes = df.groupBy(range_of(v).alias("r")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    parts = df.withColumn("r", range_of(v)).join(sizes, "r").groupBy("r", q.part_of(v, F.col("lo"), F.col("hi"), F.col("n")).alias("part")).count()
    assert sizes.count() == 1 and parts.agg(F.max("count")).first()[0] <= 2 * q.PART and parts.count() >= n / q.PART / 2


def test_flags_send_large_groups_their_own_way(spark, monkeypatch):
    from heliochron.operators import quantile as q
    monkeypatch.setattr(q, "SMALL", 50)
    rng = random.Random(5)
    rows = [(i % 7, rng.gauss(0, 1)) for i in range(700)] + [(100 + i, float(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "g long, x double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.g: (r.lo, r.hi, r.n) for r in daily_stats(d, "ts", [("lo", "x", "p10"), ("n", "x", "count"), ("hi", "x", "p90")], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g]
        assert got[g] == pytest.approx((np.quantile(v, 0.1), np.quantile(v, 0.9), len(v)))


def test_no_job_while_the_plan_is_built(spark):
    from heliochron.operators.profile import profile_numeric
    d = spark.range(0, 100).select(F.timestamp_seconds(F.col("id") * 977).alias("ts"), F.col("id").cast("double").alias("x"))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        daily_stats(d, "ts", [("p", "x", "p10")])
        step_median(d, "ts")
        profile_numeric(d, ["x"])
        exact_percentiles(d, ["x"], [0.5])
        assert list(seen.getJobIdsForGroup("plans")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_percentiles_only(spark):
    d = spark.range(0, 100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("x"))
    got = daily_stats(d, "ts", [("lo", "x", "p10"), ("hi", "x", "p90")]).orderBy("date").collect()
    assert len(got) == 5 and got[0].lo == pytest.approx(2.3) and got[0].hi == pytest.approx(20.7)


def test_daily_stats(spark):
    d = spark.range(0, 400).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 17).cast("int"))).alias("ts"),
        F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("x"))
    spec = [("p10", "x", "p10"), ("m", "x", "mean"), ("p90", "x", "p90"), ("n", "x", "count")]
    got = daily_stats(d, "ts", spec).orderBy("date").toPandas()
    pdf = d.toPandas().set_index("ts")["x"].resample("D")
    assert np.allclose(got["p10"], pdf.quantile(0.1)) and np.allclose(got["p90"], pdf.quantile(0.9))
    assert np.allclose(got["m"], pdf.mean()) and list(got["n"]) == list(pdf.count())


@pytest.mark.parametrize("chunk", [60, 3600, 10**6])
def test_step(spark, chunk):
    """Copies of an instant, chunk borders and a series with one row."""
    secs = [0, 60, 60, 60, 200, 260, 5000, 5060, 9000]
    rows = [("a", s) for s in secs] + [("b", 5)]
    d = spark.createDataFrame(rows, "s string, k long").select(
        "s", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("k").cast("decimal(18,6)"))).alias("ts"))
    m = {r.s: r for r in step_median(d, "ts", ["s"], chunk).collect()}
    assert m["a"].median_step_seconds == np.median(np.diff(secs)) and m["a"].steps == len(secs) - 1
    assert m["a"].least_step == 0 and m["a"].greatest_step == 4740
    assert m["b"].median_step_seconds is None and m["b"].steps == 0
    h = {r.s: r.step_hours for r in step_hours(d, "ts", ["s"], chunk).collect()}
    assert h == {"a": 60 / 3600, "b": 1.0}
    assert step_median(d, "ts", (), chunk).first().steps == len(rows) - 1
