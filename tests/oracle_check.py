"""Strict Spark-vs-DuckDB comparison of registered queries.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Column names, row counts and every value (order-insensitive) must be
identical; floats are compared exactly because both sides round through
the same decimal policy.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"f:{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"f:{float(v)!r}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, dt.datetime):
        return f"ts:{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, dt.date):
        return f"d:{v.isoformat()}"
    return f"s:{v}"


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as se
    qs, sqls = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = rows_of(s_cols, df.collect())
        except Exception as e:  # noqa: BLE001
            report[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, report[name], flush=True)
            continue
        if name not in sqls:
            report[name] = f"rows-only {len(s_rows)}"
            continue
        try:
            res = con.execute(sqls[name])
            d_cols = [c[0] for c in res.description]
            d_rows = rows_of(d_cols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            report[name] = f"DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, report[name], flush=True)
            continue
        if sorted(s_cols) != sorted(d_cols):
            report[name] = f"COLUMNS spark={sorted(s_cols)} duck={sorted(d_cols)}"
        elif len(s_rows) != len(d_rows):
            report[name] = f"ROWCOUNT spark={len(s_rows)} duck={len(d_rows)}"
        elif s_rows != d_rows:
            diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
            report[name] = f"VALUES differ e.g. {diff}"
        else:
            report[name] = "OK"
        if verbose:
            print(f"{name:32s} {report[name] if report[name] != 'OK' else 'OK'} "
                  f"({len(s_rows)} rows, {time.time() - t0:.1f}s)", flush=True)
    return report


if __name__ == "__main__":
    from basketry.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = local_session()
    rep = compare(spark, sf, only)
    bad = {k: v for k, v in rep.items() if v != "OK"}
    print(f"{len(rep) - len(bad)}/{len(rep)} OK")
    for k, v in bad.items():
        print("FAIL", k, v)
