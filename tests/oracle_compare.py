"""Run registered Spark queries and their DuckDB oracle side by side.

    python tests/oracle_compare.py [--sf 0.01] [key ...]

Compares row count, column names, coarse column types and an
order-insensitive multiset of rows (decimals as text, floats rounded).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    return cols, [tuple(norm(r[c]) for c in cols) for r in rows], {f.name: f.dataType.simpleString() for f in df.schema}


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    types = dict(zip(names, [str(t) for t in rel.types]))
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(norm(r[i]) for i in idx) for r in data], types


def coarse(t: str) -> str:
    t = t.lower()
    if t.startswith("decimal"):
        return t.replace(" ", "")
    if t in ("bigint", "long", "int64"):
        return "bigint"
    if t in ("int", "integer", "int32"):
        return "int"
    if t in ("string", "varchar"):
        return "string"
    if t in ("double", "float"):
        return "double"
    if t.startswith("timestamp"):
        return "timestamp"
    return t


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    s_cols, s_rows, s_types = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    d_cols, d_rows, d_types = duck_rows(con, sql)
    t2 = time.time()
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns differ: spark-only {sorted(set(s_cols) - set(d_cols))} duck-only {sorted(set(d_cols) - set(s_cols))}")
    else:
        for c in s_cols:
            if coarse(s_types[c]) != coarse(d_types[c]):
                problems.append(f"type {c}: spark {s_types[c]} duck {d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark {len(s_rows)} duck {len(d_rows)}")
    if s_cols == d_cols and Counter(s_rows) != Counter(d_rows):
        sc, dc = Counter(s_rows), Counter(d_rows)
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        problems.append(f"values differ; cols={s_cols}\n  spark-only {only_s}\n  duck-only {only_d}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    sf_dir = f"/root/testdata/sf{a.sf}"
    import __spark_entry__ as E
    from shoptally.session import get_spark

    spark = get_spark("local[8]", 8)
    qs, orc = E.queries(), E.oracle_sql()
    keys = a.keys or list(qs)
    con = duck_connect(sf_dir)
    bad = 0
    for k in keys:
        if k not in orc:
            df = qs[k](spark, sf_dir)
            n = df.count()
            print(f"[rows-only] {k}: {n} rows")
            continue
        try:
            problems, n, ts, td = compare(spark, con, k, qs[k], orc[k], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, n, ts, td = [f"error {type(e).__name__}: {str(e)[:1500]}"], -1, 0, 0
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"[{status}] {k}: rows={n} spark={ts:.1f}s duck={td:.1f}s")
        for p in problems:
            print("   ", p)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
