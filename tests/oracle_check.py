"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if v is None:
        return "None"
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only ({len(srows)} rows)"
            print(f"{name:28s} {results[name]}  {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(cols) == sorted(dcols)
        a, b = rows_of(cols, srows), rows_of(dcols, drows)
        ok = ok_cols and a == b
        results[name] = "OK" if ok else "MISMATCH"
        print(f"{name:28s} {results[name]:9s} spark={len(srows)} duck={len(drows)} {ts:.1f}s", flush=True)
        if not ok and verbose:
            if not ok_cols:
                print("   cols", cols, dcols)
            else:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:2])
                print("   only duck :", list(sb - sa)[:2])
    return results


if __name__ == "__main__":
    from murmura.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v not in ("OK",) and not v.startswith("rows-only")]
    print("FAILED:", bad)
