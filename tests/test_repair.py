"""Timestamp repair against a row-by-row statement of its rule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heliochron.operators.clean import repair_log, repair_timestamps

MIN = dt.timedelta(minutes=1)


def by_hand(times):
    bad = [t is None or t.year > 2060 for t in times]
    years = [t.year for t in times if t is not None]
    main = min(sorted(set(years)), key=lambda y: (-years.count(y), y)) if years else None
    out, i = list(times), 0
    while i < len(times):
        if not bad[i]:
            i += 1
            continue
        j = i
        while j < len(times) and bad[j]:
            j += 1
        base = out[i - 1] + MIN if i else dt.datetime(main, 1, 1)
        for k in range(i, j):
            if times[i] is None:
                out[k] = base + (k - i) * MIN
            elif times[k] is not None:
                out[k] = base + (times[k] - times[i])
            else:
                out[k] = out[k - 1] + MIN
        i = j
    return out


def run(spark, series, width):
    rows = [(s, n, t) for s, ts in series.items() for n, t in enumerate(ts)]
    random.Random(0).shuffle(rows)
    d = spark.createDataFrame(rows, "s string, n long, t timestamp_ntz")
    got = {}
    for r in repair_timestamps(d, "t", "n", ["s"], chunk_rows=width).collect():
        got.setdefault(r.s, {})[r.n] = r.fixed_time
    return got


def check(spark, series, width):
    got = run(spark, series, width)
    for s, ts in series.items():
        want = by_hand(ts)
        assert [got[s][n] for n in range(len(ts))] == want, s


T = lambda m, y=2024: dt.datetime(y, 3, 1) + m * MIN


def test_small_cases(spark):
    series = {
        "all good": [T(0), T(1), T(2)],
        "run of parsed": [T(0), T(1, 2124), T(5, 2124), T(6, 2124), T(9)],
        "first row bad": [T(0, 2124), T(3, 2124), T(9), T(10)],
        "first row missing": [None, None, T(9)],
        "run starts missing": [T(0), None, T(7, 2124), None, T(20)],
        "gap inside": [T(0), T(2, 2124), None, None, T(8, 2124), None, T(20)],
        "ends bad": [T(0), T(1), None, None],
    }
    for width in (1, 2, 3, 1000):
        check(spark, series, width)


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_cross_chunks(spark, seed):
    rng = random.Random(seed)
    series = {}
    for s in ("hot", "cold", "tiny"):
        ts, n = [], {"hot": 300, "cold": 60, "tiny": 4}[s]
        while len(ts) < n:
            kind = rng.choice(["good", "late", "none", "mix"])
            for _ in range(rng.randrange(1, 25)):
                m = len(ts) * rng.randrange(1, 3)
                k = rng.choice(["late", "none"]) if kind == "mix" else kind
                ts.append({"good": T(m), "late": T(m, 2140), "none": None}[k])
        series[s] = ts[:n]
        if all(t is None for t in series[s]):
            series[s][0] = T(0)
    for width in (5, 17):
        check(spark, series, width)


def test_without_series_key_and_log(spark):
    ts = [T(0), None, T(4, 2124), T(9), None]
    d = spark.createDataFrame([(n, t, str(t)) for n, t in enumerate(ts)], "n long, t timestamp_ntz, txt string")
    fixed = repair_timestamps(d, "t", "n", chunk_rows=2)
    assert [r.fixed_time for r in fixed.orderBy("n").collect()] == by_hand(ts)
    log = repair_log(fixed, "txt", "t").orderBy("n").collect()
    assert [r.n for r in log] == [1, 2, 4] and log[1].original_text.startswith("2124")
    # nothing bad: same columns, nothing logged
    ok = repair_timestamps(d.where(F.year("t") == 2024), "t", "n")
    assert ok.columns == fixed.columns and repair_log(ok, "txt", "t").count() == 0
