"""Run registered queries in Spark and their oracle text in DuckDB on the same
driver tables, and compare row count, column names and the multiset of rows.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [key-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(rows, key=repr)


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def check(spark, con, sf, key, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    ts = time.time() - t0
    if not sql:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    td = time.time() - t1
    c1, r1 = rows_of(scols, srows)
    c2, r2 = rows_of(dcols, drows)
    ok = c1 == c2 and r1 == r2
    out = dict(key=key, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2), duck_s=round(td, 2))
    if not ok:
        out["cols"] = (c1, c2) if c1 != c2 else None
        s1, s2 = set(r1), set(r2)
        diff1 = [r for r in r1 if r not in s2][:3]
        diff2 = [r for r in r2 if r not in s1][:3]
        out["only_spark"], out["only_oracle"] = diff1, diff2
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args()
    from tessera.plans.catalog import load_all
    from tessera.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(a.sf)
    bad = 0
    for key, (fn, sql) in sorted(load_all().items()):
        if a.prefix and not any(key.startswith(p) for p in a.prefix):
            continue
        try:
            res = check(spark, con, a.sf, key, fn, sql)
        except Exception as e:  # report and continue
            res = dict(key=key, ok=False, error=f"{type(e).__name__}: {str(e)[:400]}")
        bad += res.get("ok") is False
        print(res, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
