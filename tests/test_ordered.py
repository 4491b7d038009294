"""Chunked operators against plain Python on one list, with chunks small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from heliochron.operators import ordered as o
from heliochron.operators import features as fe


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for s in ("hot", "b"):
        for i in range(400 if s == "hot" else 37):
            out.append((s, i * 3 + rng.randrange(3), None if rng.random() < 0.6 else rng.randrange(100)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "s string, i long, v long").repartition(5)


def _by(rows):
    out = {}
    for s, i, v in sorted(rows):
        out.setdefault(s, []).append((i, v))
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 100000])
@pytest.mark.parametrize("forward", [True, False])
def test_fill_by_chunk(df, rows, width, forward):
    got = {(r.s, r.i): r.v for r in o.fill_by_chunk(df, ["v"], "i", o.chunk_by_number("i", width), ["s"], forward).collect()}
    for s, seq in _by(rows).items():
        last = None
        for i, v in (seq if forward else seq[::-1]):
            last = v if v is not None else last
            assert got[(s, i)] == last
    assert len(got) == len(rows)


@pytest.mark.parametrize("width", [1, 10, 100000])
def test_previous_and_row_number(df, rows, width):
    c = o.chunk_by_number("i", width)
    prev = {(r.s, r.i): r.previous for r in o.previous_by_chunk(df, "i", "i", c, ["s"]).collect()}
    num = {(r.s, r.i): r.row_number for r in o.row_numbers(df, "i", c, ["s"]).collect()}
    for s, seq in _by(rows).items():
        for n, (i, _) in enumerate(seq):
            assert prev[(s, i)] == (seq[n - 1][0] if n else None)
            assert num[(s, i)] == n + 1


def test_halo_windows_equal_plain_windows(spark):
    d = spark.range(0, 700).select(F.pmod("id", F.lit(2)).alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 2).cast("int")).alias("ds"),
                                   (F.pmod(F.col("id") * 37, F.lit(101))).cast("double").alias("y"))
    for width in (30, 64):
        a = fe.rolling(fe.lags(d, "y", "ds", (1, 7, 30), ["s"]), "y", "ds", (7, 30), ["s"])
        b = fe.rolling(fe.lags(d, "y", "ds", (1, 7, 30), ["s"], width=width), "y", "ds", (7, 30), ["s"], width=width)
        r = lambda x: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in row) for row in x.fillna(-1).collect())
        assert r(a) == r(b)


def test_halo_must_fit(spark):
    d = spark.createDataFrame([("2020-01-01",)], "t string").select(F.col("t").cast("date").alias("ds"))
    with pytest.raises(ValueError):
        o.with_halo(d, "ds", "day", 5, 6)


def test_fill_in_chunks_equals_fill(spark):
    import datetime as dt
    from heliochron.operators.features import fill
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i) if (i * 7 + len(s)) % 5 == 0 else None) for s in ("a", "bb") for i in range(40)]
    d = spark.createDataFrame(rows, "s string, ds date, y double")
    for method in ("ffill", "bfill"):
        for both in (True, False):
            want = sorted(map(tuple, fill(d, ["y"], "ds", ["s"], method, both).collect()), key=str)
            assert sorted(map(tuple, fill(d, ["y"], "ds", ["s"], method, both, width=3).collect()), key=str) == want
