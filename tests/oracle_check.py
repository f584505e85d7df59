"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python tests/oracle_check.py [prefix ...]      # data folder from QUASI_SF_DIR

QUASI_PLAIN_SESSION=1 uses a session with Spark's own defaults instead of the library's local one.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    out.sort(key=lambda t: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in t))
    return sorted(columns), out


def compare(got_cols, got, want_cols, want) -> str:
    got_cols, got = _rows(got_cols, got)
    want_cols, want = _rows(want_cols, want)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else ""


def check(spark, con, name, fn, sql, sf_dir) -> tuple[str, int, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows only" if rows else "EMPTY"), len(rows), took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    return compare(df.columns, rows, want_cols, cur.fetchall()), len(rows), took


def main(prefixes):
    import __spark_entry__ as entry
    from quasi.session import local_session

    sf_dir = os.environ.get("QUASI_SF_DIR", "/root/testdata/sf0.01")
    cpus = os.environ.get("BENCH_CPUS", "8")
    if os.environ.get("QUASI_PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{cpus}]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session("oracle-check", cpus)
    con = connect(sf_dir)
    sqls, failures = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            result, n, took = check(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            result, n, took = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0, 0.0
        ok = result in ("", "rows only")
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:6d} rows {took:6.2f}s {result}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
