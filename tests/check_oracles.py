"""Compare registered queries with their DuckDB statements: python tests/check_oracles.py [sf_dir] [query or module name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from slidemesh.runtime import build_session  # noqa: E402


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def compare(spark, con, sf, name, fn, stmt):
    t = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - t
    if stmt is None:
        return True, f"{name}: {len(got)} rows, no oracle, {took:.1f}s"
    t = time.time()
    rel = con.sql(stmt)
    want = rel.fetchall()
    cols = [c for c in rel.columns]
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    note = f"{name}: spark {len(a)} ({took:.1f}s) duck {len(b)} ({time.time() - t:.1f}s)"
    types = dict(zip(cols, map(str, rel.types)))
    odd = [f"{c}:{types[c]}" for c in cols if "HUGEINT" in types[c] or "DECIMAL" in types[c]]
    sp = dict(df.dtypes)
    pair = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd += [f"{c}:{sp[c]}/{types[c]}" for c in cols if sp[c] in pair and pair[sp[c]] != types[c]]
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{note} DIFF {diff}"
    return True, note + (f" TYPES {odd}" if odd else "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("oracles", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), []
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] and fn.__module__.rsplit(".", 1)[-1] not in sys.argv[2:]:
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{name}: ERROR {type(exc).__name__} {str(exc)[:600]}"
        print("ok  " if ok else "BAD ", note, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
