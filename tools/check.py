"""Run registered queries next to their SQL and report differences.

usage: python tools/check.py [--sf 0.01] [--only regex] [--explain]
"""

from __future__ import annotations

import argparse
import math
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from tidemark.catalog import load  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def sort_key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float, bool)) else "n", v if v is not None else 0) for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: spark-only {set(spark_cols) - set(duck_cols)} sql-only {set(duck_cols) - set(spark_cols)}"
    cols = sorted(spark_cols)
    a = sorted((tuple(norm(r[spark_cols.index(c)]) for c in cols) for r in spark_rows), key=sort_key)
    b = sorted((tuple(norm(r[duck_cols.index(c)]) for c in cols) for r in duck_rows), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    sa, sb = set(a), set(b)
    bad = [x for x in a if x not in sb]
    if not bad:
        for c, v in zip(cols, a[0] if a else ()):
            pass
        return None
    other = [x for x in b if x not in sa]
    return f"{len(bad)} of {len(a)} rows differ\n   {cols}\n   spark {bad[0]}\n   sql   {other[0] if other else None}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    base = f"/root/testdata/sf{args.sf}"
    spark = build_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    reg = load()
    bad = []
    for name, build in reg.queries.items():
        if args.only and not re.search(args.only, name):
            continue
        try:
            t0 = time.time()
            df = build(spark, base)
            if args.explain:
                df.explain("formatted")
            rows = df.collect()
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark error {str(e)[:1500]}", flush=True)
            continue
        sql = reg.sql.get(name)
        if sql is None:
            print(f"rows {name}: {len(rows)} rows, {len(df.columns)} cols, {ts:.1f}s", flush=True)
            continue
        try:
            t0 = time.time()
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            duck = cur.fetchall()
            td = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: sql error {str(e)[:1200]}", flush=True)
            continue
        diff = compare(rows, df.columns, duck, cols)
        if diff:
            bad.append(name)
            print(f"FAIL {name}: {diff}", flush=True)
        else:
            nulls = [c for k, c in enumerate(df.columns) if rows and all(norm(x[k]) is None for x in rows)]
            note = f" ALL-NULL {nulls}" if nulls else ""
            note += " EMPTY" if not rows else ""
            print(f"ok   {name}: {len(rows)} rows, {ts:.1f}s, sql {td:.1f}s{note}", flush=True)
    print("BAD:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
