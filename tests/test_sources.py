import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import types as T

from heliochron import sources as src
from heliochron.operators.profile import profile_folder


def put(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


def test_bom_and_repeated_header(spark, tmp_path):
    p = put(str(tmp_path / "a.csv"), "﻿LocalTime,W\n2024-01-01,1\nLocalTime,W\n2024-01-02,2\n")
    d = src.read_csv(spark, p)
    assert d.columns == ["LocalTime", "W"]
    assert [r.W for r in src.drop_repeated_headers(d).collect()] == ["1", "2"]
    typed = src.drop_repeated_headers(src.read_csv(spark, p, "`﻿LocalTime` string, W double"))
    assert [r.W for r in typed.collect()] == [1.0, 2.0]


PRE = "Latitude (decimal degrees):\t24.148\r\nLongitude (decimal degrees):\t-120.703\r\n\r\nmonth,year\r\n1,2015\r\n2,2008\r\ntime,P,T2m\r\n"
FOOT = "\r\nP: PV system power (W)\r\nT2m: 2-m air temperature (degree Celsius)\r\n"


def test_preamble_files(spark, tmp_path):
    put(str(tmp_path / "p" / "one.csv"), PRE + "20050101:0010,1.5,20\r\n20050101:0110,,21\r\n" + FOOT)
    put(str(tmp_path / "p" / "two.csv"), PRE.replace("24.148", "-3.5") + "2005-01-01 00:10:00,7,x\r\n" + FOOT)
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("P", T.DoubleType()), T.StructField("T2m", T.DoubleType())])
    rows = src.read_preamble_csv(spark, str(tmp_path / "p"), schema).orderBy("file", "time").collect()
    assert [(r.file[-7:], r.time, r.P, r.T2m) for r in rows] == [
        ("one.csv", "20050101:0010", 1.5, 20.0), ("one.csv", "20050101:0110", None, 21.0), ("two.csv", "2005-01-01 00:10:00", 7.0, None)]
    meta = src.read_preamble_meta(spark, str(tmp_path / "p")).orderBy("file").collect()
    assert [(m.latitude, m.longitude, m.years) for m in meta] == [(24.148, -120.703, {1: 2015, 2: 2008}), (-3.5, -120.703, {1: 2015, 2: 2008})]


def test_monthly_files(spark, tmp_path):
    put(str(tmp_path / "m" / "467490-2025-12.csv"), "時,壓\nObsTime,StnPres\n1,1000\n31,1001\n")
    put(str(tmp_path / "m" / "467490-2001-11 (1).csv"), "時,溫\nObsTime,T Max\n2,\"25,5\"\n")
    put(str(tmp_path / "m" / "467490-2002-03.csv"), "時,x\nyyyymmddhh,x\n2002030512,4\n")
    got = {str(r.Date): r for r in src.read_monthly_files(spark, str(tmp_path / "m")).collect()}
    assert set(got) == {"2025-12-01", "2025-12-31", "2001-11-02", "2002-03-05"}
    a, b = got["2025-12-01"], got["2001-11-02"]
    assert (a.ObsTime, a.StnPres, a["T Max"], a.Year, a.Month, a.Day) == ("01", "1000", None, 2025, 12, 1)
    assert (b["T Max"], b.StnPres, b.Day) == ("25,5", None, 2) and got["2002-03-05"].x == "4"


def test_union_folder(spark, tmp_path):
    put(str(tmp_path / "u" / "a.csv"), "﻿ date ,發電（kWh）\n1,2\n")
    put(str(tmp_path / "u" / "b b.csv"), "發電（kWh）,site name\n3,x\n")
    put(str(tmp_path / "u" / "c.csv"), "發電（kWh）,site name\n4,y\n")
    d = src.union_folder(spark, str(tmp_path / "u"))
    assert set(d.columns) == {"date", "發電_kWh", "site_name"}
    assert {(r.date, r["發電_kWh"], r.site_name) for r in d.collect()} == {("1", "2", None), (None, "3", "x"), (None, "4", "y")}


def test_latest_file(spark, tmp_path):
    for i, n in enumerate(("new_30d.csv", "old_30d.csv", "newer_60d.csv")):
        p = put(str(tmp_path / "l" / str(i) / n), "x\n1\n")
        os.utime(p, (time.time() - {0: 50, 1: 500, 2: 0}[i],) * 2)
    assert src.latest_file(spark, str(tmp_path / "l"), "*_30d.csv").endswith("0/new_30d.csv")
    assert src.latest_file(spark, str(tmp_path / "l"), "*_90d.csv") is None


def test_sniff(spark, tmp_path):
    a = put(str(tmp_path / "l1.csv"), "# made by hand, once\nname;v\ncafé;1,5\nthé;2\n", "latin-1")
    b = put(str(tmp_path / "u8.csv"), "name,v\ncafé,1\nthé;x,2\n")
    assert [tuple(r) for r in src.read_csv_any(spark, a).collect()] == [("café", "1,5"), ("thé", "2")]
    assert src.sniff(spark, b)["encoding"] == "UTF-8" and [tuple(r) for r in src.read_csv_any(spark, b).collect()] == [("café", "1"), ("thé;x", "2")]


def test_json(spark, tmp_path):
    doc = {"inputs": {"x": 1}, "outputs": {"tmy_hourly": [{"time(UTC)": "20070101:0100", "G(h)": 1.5}, {"time(UTC)": "bad", "G(h)": 2.0}]}}
    p = put(str(tmp_path / "j" / "a.json"), json.dumps(doc, indent=2))
    schema = T.StructType([T.StructField("time(UTC)", T.StringType()), T.StructField("G(h)", T.DoubleType())])
    rows = src.read_hourly_json(spark, p, "outputs.tmy_hourly", schema).collect()
    assert [(r.time_utc, r["G(h)"]) for r in rows] == [(dt.datetime(2007, 1, 1, 1), 1.5)]


def test_write_table_rounds_and_refuses_to_overwrite(spark, tmp_path):
    d = spark.createDataFrame([(1, 1 / 3)], "i int, v double")
    p = str(tmp_path / "w")
    src.write_table(d, p, "csv", digits=5)
    assert src.read_csv(spark, p, "i int, v double").first().v == 0.33333
    with pytest.raises(Exception):
        src.write_table(d, p, "csv")


def test_profile_folder(spark, tmp_path):
    put(str(tmp_path / "f" / "a.csv"), "LocalTime,W,tag\n2024-01-01 00:00:00,1,x\n2024-01-01 01:00:00,3,x\n2024-01-01 02:00:00,,y\n")
    put(str(tmp_path / "f" / "sub" / "b.csv"), "LocalTime,W,tag\n2024-01-01,7,z\n")
    got = {(os.path.basename(r.file), r.variable): r for r in profile_folder(spark, str(tmp_path / "f"), "LocalTime", recursive=True).collect()}
    assert set(got) == {(f, v) for f in ("a.csv", "b.csv") for v in ("W", "tag")}
    assert got["a.csv", "W"].median == 2 and got["a.csv", "W"].missing_count == 1 and got["a.csv", "tag"].top == "x"
    assert got["a.csv", "W"].inferred_freq == "hour" and got["b.csv", "tag"].freq == 1


def test_folder_with_quoted_header_and_odd_names(spark, tmp_path):
    (tmp_path / "a]b.csv").write_text('"x,1",y\n1,2\n')
    (tmp_path / "50%25.csv").write_text('y,"x,1"\n4,3\n')
    (tmp_path / "plain name.csv").write_text("y\n5\n")
    d = src.union_folder(spark, str(tmp_path), clean=False, with_file=True)
    got = sorted((r["x,1"] or "", r["y"], r["file"].rsplit("/", 1)[1]) for r in d.collect())
    assert got == [("", "5", "plain name.csv"), ("1", "2", "a]b.csv"), ("3", "4", "50%25.csv")]


def test_separator_outside_quotes_on_all_lines(spark, tmp_path):
    from heliochron.sources.readers import sniff
    (tmp_path / "f.csv").write_text("a;b\n" + "1;2\n" * 80 + '3;"y;z"\n4;"p,q"\n')
    assert sniff(spark, str(tmp_path / "f.csv"))["sep"] == ";"


def test_preamble_columns_by_the_header_of_each_file(spark, tmp_path):
    from pyspark.sql import types as T
    from heliochron.sources.readers import read_preamble_csv
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("P", T.DoubleType()), T.StructField("T2m", T.DoubleType())])
    (tmp_path / "a.csv").write_text("Latitude: 1\ntime,P,T2m\n20050101:0010,1,2\n")
    (tmp_path / "b.csv").write_text("Latitude: 1\ntime,T2m,P,Int\n20050101:0010,2,1,0\n")
    (tmp_path / "c.csv").write_text("20050101:0010,1,2\n")
    got = read_preamble_csv(spark, str(tmp_path), schema).select("time", "P", "T2m").collect()
    assert [tuple(r) for r in got] == [("20050101:0010", 1.0, 2.0)] * 3


def test_long_monthly_file_is_read_whole(spark, tmp_path):
    (tmp_path / "s-2024-01.csv").write_text("title\nObsTime,x\n" + "01,5\n" * 1_000_050)
    assert src.read_monthly_files(spark, str(tmp_path)).count() == 1_000_050


def test_scratch_needs_a_shared_folder_and_can_be_removed(spark, tmp_path, monkeypatch):
    import os
    from heliochron import session
    monkeypatch.setattr(session, "_WRITTEN", [])
    path = session.scratch_path(spark, "t").removeprefix("file:")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path) and session.remove_scratch(spark) == 1 and not os.path.exists(path)

    class Elsewhere:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Elsewhere
    with pytest.raises(RuntimeError):
        session.scratch_path(Far, "t")


def test_first_lines_take_one_task_a_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text("h\n" + "x\n" * 400_000)
    for i in range(5):
        (tmp_path / f"s{i}.csv").write_bytes(b"caf\xe9;\n2\n3\n")
    (tmp_path / "empty.csv").write_text("")
    d = src.first_lines(spark, str(tmp_path), 2)
    got = {os.path.basename(r.file): [bytes(x) for x in r.lines] for r in d.collect()}
    assert got == {"long.csv": [b"h", b"x"], **{f"s{i}.csv": [b"caf\xe9;", b"2"] for i in range(5)}}
    assert d.rdd.getNumPartitions() >= 6 and spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 40)


def test_files_of_a_folder_are_judged_one_by_one(spark, tmp_path):
    put(str(tmp_path / "u.csv"), "# note\nname,v\ncafé,1\nthé\n")
    put(str(tmp_path / "l.csv"), "v;name\n2;café\n" + "3;x\n" * 50, "latin-1")
    put(str(tmp_path / "q.csv"), 'name;v\n"a;b";4\n')
    put(str(tmp_path / "one.csv"), "name\nz\n")
    put(str(tmp_path / "over.csv"), "name,v\na,1\nb,2,3\n")
    put(str(tmp_path / "none.csv"), "# only\n\n")
    put(str(tmp_path / "empty.csv"), "")
    put(str(tmp_path / "raw.csv"), "a,b\n1,\0\n")
    with open(tmp_path / "torn.csv.gz", "wb") as f:
        f.write(b"\x1f\x8b\x08\0torn")
    got = {os.path.basename(r.file): (r.encoding, r.sep, r.reason) for r in src.folder_layouts(spark, str(tmp_path)).collect()}
    assert got == {"u.csv": ("UTF-8", ",", None), "l.csv": ("ISO-8859-1", ";", None), "q.csv": ("UTF-8", ";", None), "one.csv": ("UTF-8", ",", None),
                   "over.csv": ("UTF-8", None, "a line has more cells than the header"), "none.csv": ("UTF-8", ",", "no header"),
                   "empty.csv": ("UTF-8", ",", "no header"), "raw.csv": ("UTF-8", ",", "not a text file"), "torn.csv.gz": ("UTF-8", ",", "no header")}
    with pytest.warns(UserWarning) as said:
        d = src.read_folder_any(spark, str(tmp_path))
    assert sorted(str(w.message).rsplit("/", 1)[1] for w in said if "passed over" in str(w.message)) == [
        "empty.csv: no header", "none.csv: no header", "over.csv: a line has more cells than the header", "raw.csv: not a text file", "torn.csv.gz: no header"]
    rows = {(r.name, r.v) for r in d.collect()}
    assert rows == {("café", "1"), ("thé", None), ("café", "2"), ("x", "3"), ("a;b", "4"), ("z", None)}


def test_union_names_files_without_a_header(spark, tmp_path):
    put(str(tmp_path / "a.csv"), "x,y\n1,2\n")
    put(str(tmp_path / "b.csv"), "\n  \n")
    with pytest.warns(UserWarning, match="b.csv: no header"):
        assert [tuple(r) for r in src.union_folder(spark, str(tmp_path)).collect()] == [("1", "2")]


def test_json_of_unknown_nesting(spark, tmp_path):
    docs = {"a": {"inputs": {"months": [{"month": 1}], "date": "x"}, "outputs": {"tmy_hourly": [{"time(UTC)": "20070101:0100", "G(h)": 1.5, "T2m": 3}, {"time(UTC)": "bad", "G(h)": 2}]}},
            "b": {"data": {"deep er": {"rows": [{"Date`x": "2007-01-01 02:00:00", "T2m": -1.25, "VOID": None}]}}}, "c": {"outputs": {}}, "d": [1]}
    for name, doc in docs.items():
        put(str(tmp_path / "j" / f"{name}.json"), json.dumps(doc, indent=1))
    put(str(tmp_path / "j" / "e.json"), "{torn")
    got = {os.path.basename(r.file): (r.time_utc, r["G(h)"], r.T2m) for r in src.read_hourly_json_any(spark, str(tmp_path / "j")).collect()}
    assert got == {"a.json": (dt.datetime(2007, 1, 1, 1), 1.5, 3.0), "b.json": (dt.datetime(2007, 1, 1, 2), None, -1.25)}
    put(str(tmp_path / "n" / "x.json"), '{"a": [{"time": 1}]}')
    with pytest.raises(ValueError, match="no array"):
        src.read_hourly_json_any(spark, str(tmp_path / "n"))


def test_preamble_lines_are_not_sent_anywhere(spark, tmp_path):
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("P", T.DoubleType())])
    put(str(tmp_path / "a.csv"), "Latitude: 1\ntime,P\n20050101:0010,1\n")
    put(str(tmp_path / "b.csv"), "Latitude: 1\ntime,x,P\n20050101:0010,2,1\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = src.read_preamble_csv(spark, str(tmp_path), schema)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "Join" not in plan
