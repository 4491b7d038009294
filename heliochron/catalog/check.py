"""Run registered queries against their SQL in DuckDB: ``python -m heliochron.catalog.check [sf] [names...]``."""

from __future__ import annotations

import sys
import time

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return float(v)
        return str(v)
    return sorted((tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False)), key=repr)


def compare(spark, con, name: str, f, sql: str | None, sf: str) -> tuple[bool, str]:
    t0 = time.time()
    out = f(spark, sf)
    got = out.toPandas()
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} rows, {t1 - t0:.2f}s"
    want = con.execute(sql).df()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.2f}s, sql {t2 - t1:.2f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = norm(got), norm(want)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"
    return True, note


def main(argv) -> int:
    from heliochron.catalog import QUERIES, SQL
    from heliochron.session import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if len(argv) < 2 or any(n.startswith(a) for a in argv[1:])]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for n in names:
        try:
            ok, note = compare(spark, con, n, QUERIES[n], SQL.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(("ok   " if ok else "FAIL ") + n, note, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
