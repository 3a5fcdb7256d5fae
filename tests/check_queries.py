"""Run the named queries against their SQL: ``python tests/check_queries.py [folder] [name ...]``."""

from __future__ import annotations

import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from runlens.plans.adapters import TABLES  # noqa: E402


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = entry_points.queries()[name](spark, folder)
    got_columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    text = entry_points.oracle_sql().get(name)
    if text is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    result = con.execute(text)
    types = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = normal([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} rows vs {len(want)}; first differences {diff}"
    mismatched = _type_gaps(dict(df.dtypes), types)
    return True, f"{len(got)} rows, {spent:.1f}s {mismatched or ''}"


_SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "decimal(18,2)": "DECIMAL(18,2)",
}


def _type_gaps(spark_types: dict[str, str], sql_types: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {c: (t, sql_types[c]) for c, t in spark_types.items() if _SAME.get(t) != sql_types[c]}


if __name__ == "__main__":
    from runlens.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, con = build_session("check", 8), oracle(folder)
    names = sys.argv[2:] or sorted(entry_points.queries())
    failed = 0
    for name in names:
        try:
            ok, note = compare(session, con, folder, name)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
