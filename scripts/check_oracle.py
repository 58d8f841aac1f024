"""Run every registered query on Spark and its oracle SQL on DuckDB; compare.

Usage: python scripts/check_oracle.py [--sf-dir DIR] [--only name,name] [--show N]

Comparison: row count, sorted column names, and the multiset of rows
(values normalised: floats rounded to 9 places, NULL kept).
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from facetspark.plans.catalog import TABLES  # noqa: E402
from facetspark.plans.queries import ORACLES, QUERIES  # noqa: E402
from facetspark.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("--out", default="")
    a = ap.parse_args()
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf_dir}/{t}.parquet')")
    names = [n for n in QUERIES if not a.only or n in a.only.split(",")]
    report = {}
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, a.sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark_error", "error": str(e)[:500]}
            print(f"{name:22s} SPARK ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        sql = ORACLES.get(name)
        if sql is None:
            report[name] = {"status": "rows_only", "rows": len(srows), "sec": round(ts, 2)}
            print(f"{name:22s} rows-only {len(srows)} rows  spark {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "sql_error", "error": str(e)[:500]}
            print(f"{name:22s} SQL ERROR {str(e)[:300]}")
            continue
        sc, sn = rows_of(scols, srows)
        dc, dn = rows_of(dcols, drows)
        ok = sn == dn and sc == dc
        report[name] = {"status": "match" if ok else "mismatch", "rows": len(srows), "oracle_rows": len(drows),
                        "sec": round(ts, 2)}
        print(f"{name:22s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)}  spark {ts:.1f}s")
        if not ok:
            if sn != dn:
                print("   columns:", sn, "vs", dn)
            else:
                only_s = list((sc - dc).elements())[: a.show]
                only_d = list((dc - sc).elements())[: a.show]
                print("   spark-only:", only_s)
                print("   duck-only: ", only_d)
    if a.out:
        with open(a.out, "w") as f:
            json.dump(report, f, indent=1)
    bad = [n for n, r in report.items() if r["status"] not in ("match", "rows_only")]
    print("failing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
