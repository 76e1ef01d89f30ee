"""Run registered queries next to their SQL checks and compare values.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return ("ts", value.date().isoformat())
    return "NULL" if value is None else f"{type(value).__name__}:{value}"


def compare(spark, con, folder: str, name: str, function, sql: str) -> tuple[str, float, int]:
    started = time.time()
    df = function(spark, folder)
    rows = df.collect()
    took = time.time() - started
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if names != sorted(theirs_names):
        return f"columns differ: {set(names) ^ set(theirs_names)}", took, len(rows)
    if len(rows) != len(theirs):
        return f"row counts differ: {len(rows)} vs {len(theirs)}", took, len(rows)
    order = [theirs_names.index(n) for n in names]
    ours = sorted([tuple(cell(r[n]) for n in names) for r in rows], key=repr)
    other = sorted([tuple(cell(r[i]) for i in order) for r in theirs], key=repr)
    bad = [(a, b) for a, b in zip(ours, other) if a != b]
    if bad:
        a, b = bad[0]
        diff = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
        return f"{len(bad)} of {len(ours)} rows differ, first: {diff}", took, len(rows)
    return "ok", took, len(rows)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from hindcast.session import local_session

    folder, wanted = sys.argv[1], set(sys.argv[2:])
    spark, con, checks, failed = local_session(8), connect(folder), oracle_sql(), 0
    for name, function in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in checks:
                status, took, n = compare(spark, con, folder, name, function, checks[name])
            else:
                started = time.time()
                n = len(function(spark, folder).collect())
                status, took = "rows only" if n else "EMPTY", time.time() - started
        except Exception as error:  # report and go on
            status, took, n = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, -1
        failed += status not in ("ok", "rows only")
        print(f"{name:34s} {took:6.2f}s {n:7d} rows  {status}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
