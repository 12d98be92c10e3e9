"""Run registered queries beside their comparison SQL: python tests/compare.py [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from flowloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(clean(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


def compare(spark, sf: str, names: list[str]) -> int:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or list(queries):
        started = time.time()
        try:
            df = queries[name](spark, sf)
            got = df.toPandas()
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name:26s} {len(got):7d} rows {took:6.1f}s", flush=True)
                continue
            started = time.time()
            expected = con.execute(oracles[name]).df()
            duck = time.time() - started
            a, b = rows_of(got), rows_of(expected)
            same_names = sorted(got.columns) == sorted(expected.columns)
            ok = a == b and same_names
            failed += not ok
            print(f"{'ok  ' if ok else 'FAIL'}  {name:26s} {len(a):7d} / {len(b):7d} rows {took:6.1f}s duck {duck:5.1f}s", flush=True)
            if not ok:
                if not same_names:
                    print("   columns", sorted(got.columns), sorted(expected.columns))
                sa, sb = set(map(repr, a)), set(map(repr, b))
                print("   columns:", sorted(got.columns))
                print("   spark only", len(sa - sb), sorted(sa - sb)[:3])
                print("   duck only ", len(sb - sa), sorted(sb - sa)[:3])
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    return failed


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(min(compare(session, sf_dir, sys.argv[2:]), 100))
