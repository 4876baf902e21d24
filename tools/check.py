"""Run registered queries beside their DuckDB twins and compare the results.

    python tools/check.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gristmill.plans import catalog  # noqa: E402
from gristmill.plans.registry import REGISTRY, TABLES  # noqa: E402
from gristmill.session import build_session  # noqa: E402


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def oracle_connection(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(spark, con, query, folder):
    """(ok, seconds, message) of one query."""
    start = time.time()
    df = query(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if query.oracle is None:
        return bool(got_rows), seconds, f"rows-only {len(got_rows)}"
    rel = con.execute(query.oracle)
    columns = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, seconds, f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = rows_of(df.columns, got_rows), rows_of(columns, want_rows)
    if got == want:
        return True, seconds, f"rows {len(got)}"
    if len(got) != len(want):
        head = f"row count {len(got)} != {len(want)}"
    else:
        head = f"{sum(a != b for a, b in zip(got, want))} of {len(got)} rows differ"
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return False, seconds, f"{head}\n   spark  {only_got}\n   duckdb {only_want}"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    catalog.load()
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    bad = []
    for name, query in REGISTRY.items():
        if args.names and not any(part in name for part in args.names):
            continue
        try:
            ok, seconds, message = compare(spark, con, query, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, seconds, message = False, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if ok else 'BAD'} {seconds:6.2f}s {name}: {message[:1500]}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
