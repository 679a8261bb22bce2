"""Run registered queries against their DuckDB twins: ``python -m tests.oracle [sf] [prefix …]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from scanloom.plans.testbed import BASE


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("\x1f".join(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_columns, got = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns, want = _table(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} of {len(got)} rows differ, e.g. {wrong[0]}" if wrong else None


def main(argv: list[str]) -> int:
    from scanloom.plans import ORACLES, QUERIES
    from scanloom.session import local_session

    sf = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark, con, bad = local_session("8"), connect(sf), 0
    for name, run in QUERIES.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s{'' if name in ORACLES else ' (rows only)'}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
