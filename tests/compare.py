"""Run registered queries next to their SQL and compare whole results.

Usage: python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    return (type(value).__name__, str(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(cell(row[i]) for i in order) for row in rows], key=repr)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = table([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} <> {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} <> {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"first difference {a} <> {b}"
    return None


def main() -> None:
    from sievemark.plans import registry
    from sievemark.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    queries, oracles = registry.load()
    names = args or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], folder)
            else:
                problem = None
                rows = len(queries[name](spark, folder).collect())
                print(f"rows-only {name}: {rows}", flush=True)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
