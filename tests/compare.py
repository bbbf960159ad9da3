"""Run registered queries against their check SQL in DuckDB: python tests/compare.py [sf] [names...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else (int(value) if value.is_integer() and abs(value) < 1e15 else value)
    if isinstance(value, bool):
        return value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    cursor = con.execute(sql)
    names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} != {names}"
    if got != want:
        return f"{sum(got.values())} vs {sum(want.values())} rows; extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    from rastrel.queries import CHECKS, QUERIES
    from rastrel.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = difference(df, con, CHECKS[name]) if name in CHECKS else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
