"""Run a plan and its SQL side by side and compare the rows."""

from __future__ import annotations

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from attestary.plans.registry import TABLES


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def expected(con, sql: str):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def actual(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from attestary.session import get_spark
    folder, only = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            got = actual(fn(spark, folder))
            took, t = time.time() - t, time.time()
            sql = entry.oracle_sql().get(name)
            diff = difference(got, expected(con, sql)) if sql else None
            note = "ok" if sql and not diff else "rows" if not sql else diff
        except Exception as e:  # show every failing plan in one run
            took, got, note, diff = 0, ([], []), f"{type(e).__name__}: {str(e)[:700]}", True
        if diff:
            failed.append(name)
        print(f"{name:26} {len(got[1]):7} rows {took:6.2f}s  {note[:900]}", flush=True)
    print("FAILED", failed)
