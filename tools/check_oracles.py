"""Run catalogue queries on Spark and their oracle text on DuckDB and compare.

    python tools/check_oracles.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from framelens import build_session  # noqa: E402
from framelens.plans.catalogue import oracle_sql, queries  # noqa: E402
from framelens.plans.registry import TABLES  # noqa: E402


def cell(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("0",) if math.isnan(v) else ("f", round(v, 6))
    if isinstance(v, int):
        return ("i", v)
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    return ("s", str(v))


def compare(left, lcols, right, rcols):
    if sorted(lcols) != sorted(rcols):
        return f"columns {sorted(lcols)} != {sorted(rcols)}"
    order = sorted(lcols)
    li, ri = [lcols.index(c) for c in order], [rcols.index(c) for c in order]
    a = sorted(tuple(cell(r[i]) for i in li) for r in left)
    b = sorted(tuple(cell(r[i]) for i in ri) for r in right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"differs: {str(dict(zip(order, x)))[:300]} != {str(dict(zip(order, y)))[:300]}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad, n = oracle_sql(), 0, 0
    for name, build in queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        n += 1
        t0 = time.time()
        try:
            df = build(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: spark {str(e)[:900]}", flush=True)
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(rows)} rows, {dt:.2f}s (no oracle)", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            msg = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
        except Exception as e:
            msg = f"duckdb {str(e)[:600]}"
        if msg is None and not rows:
            msg = "both empty"
        if msg:
            bad += 1
            print(f"FAIL {name}: {msg}", flush=True)
        else:
            print(f"ok   {name}: {len(rows)} rows, {dt:.2f}s", flush=True)
    print(f"{n} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
