"""Compare registered queries with their SQL on one scale folder.

    python tools/check_sql.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import importlib.util
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t)
    )


def main() -> int:
    from lectern.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spec = importlib.util.spec_from_file_location("entry_module", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = build_session(
        "check", "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            t = time.time()
            df = fn(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t
            if name not in sql:
                print(f"ROWS {name} rows={len(got[1])} {took:.1f}s", flush=True)
                continue
            t = time.time()
            cur = con.execute(sql[name])
            want = rows_of([c[0] for c in cur.description], cur.fetchall())
            same = got == want
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'} {name} rows={len(got[1])}/{len(want[1])} {took:.1f}s sql {time.time() - t:.1f}s", flush=True)
            if not same:
                print("  columns", got[0], want[0])
                a, b = set(got[1]), set(want[1])
                for label, side in (("spark", sorted(a - b, key=str)), ("sql", sorted(b - a, key=str))):
                    for r in side[:3]:
                        print("  only", label, str(r)[:700])
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
