"""The registered queries: contract, and a run against SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from heliochron.catalog import check

QUICK = ["b1_cell_typing", "b7_timestamp_repair_by_series", "c1_c2_c3_minutes_to_days", "c7_step_estimate", "c9_daily_statistics",
         "d2_outer_join_by_date", "d8_typical_year", "e13_trailing_mean_fill", "e2_e3_in_chunks", "f1_map_range", "g8_backtest_scores",
         "g13_model_ranking", "h10_compare_models", "i1_numeric_profile", "a3_preamble_csv", "a5_monthly_files"]


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf, con, name):
    ok, note = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, note


def test_hourly_stream(spark, sf, tmp_path):
    from pyspark.sql import functions as F
    from heliochron.operators.resample import resample
    from heliochron.streaming import hourly_stream
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "value")
    folder = str(tmp_path / "in")
    for lo, hi in ((0, 10), (10, 20), (20, 32)):
        e.where(F.day("ts").between(lo + 1, hi)).coalesce(1).write.mode("append").parquet(folder)
    live = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (hourly_stream(live, "ts", ["value"], ["event_type"], "40 days").writeStream.outputMode("update").format("memory")
         .queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r.event_type, r.ts): r.value for r in spark.table("hours").collect()}
    want = {(r.event_type, r.ts): r.value for r in resample(e, "ts", "hour", {"value": "mean"}, ["event_type"], full=False).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_import_without_the_text_operators(tmp_path):
    """A copy without them, and without the pipeline or with it left behind, imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for keep_pipeline in (False, True):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(os.path.join(root, "heliochron"), copy / "heliochron", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ["__spark_entry__.py", *["corpus_pipeline.py"] * keep_pipeline]:
            if os.path.exists(os.path.join(root, f)):
                shutil.copy(os.path.join(root, f), copy / f)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql(); print('fine')"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        assert out.stdout.strip() == "fine", out.stderr[-800:]
