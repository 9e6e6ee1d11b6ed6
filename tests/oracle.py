"""Runs registered queries and their SQL side by side.  python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from attestry.session import local_session
from attestry.sources.tables import GIVEN_TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}", len(got)
    a, b = normal(got, frame.columns), normal(want, columns)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return (
            f"rows {len(a)} vs {len(b)}; spark only {sorted(sa - sb)[:3]}; sql only {sorted(sb - sa)[:3]}; "
            f"diff {len(sa - sb)}/{len(sb - sa)} cols {sorted(columns)}"
        ), len(got)
    names = sorted(columns)
    kinds = {c: t for c, t in frame.dtypes}
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [f"{c}: {kinds[c]}/{types[c]}" for c in names if expected.get(kinds[c], types[c]) != types[c]]
    return ("types " + ", ".join(odd)) if odd else None, len(got)


def main():
    import __spark_entry__ as entry

    sf, names = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            if name in oracles:
                problem, rows = compare(spark, con, folder, queries[name], oracles[name])
            else:
                problem, rows = None, queries[name](spark, folder).count()
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(problem)
        label = "FAIL " + problem if problem else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:28s} {rows:8d} rows {time.time() - start:6.2f}s {label}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
