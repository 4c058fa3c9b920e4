"""Run registered queries in Spark and their SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's check: same column names, same row count, and the same
multiset of rows (columns sorted by name, doubles compared exactly;
set LOOSE=1 to compare them at 6 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from wordloom.plans.catalog import ORACLE, QUERIES  # noqa: E402
from wordloom.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) if os.environ.get("LOOSE") else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, con, name, sf_dir):
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if name not in ORACLE:
        return dict(name=name, status="rows-only", rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.sql(ORACLE[name])
    ocols = res.columns
    orows = res.fetchall()
    t2 = time.time()
    out = dict(name=name, rows=len(srows), oracle_rows=len(orows),
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(scols) != sorted(ocols):
        out.update(status="COLUMNS", spark_cols=scols, oracle_cols=ocols)
        return out
    a, b = rows_of(scols, srows), rows_of(ocols, orows)
    if a == b:
        out["status"] = "ok"
    else:
        out.update(status="VALUES", only_spark=list((a - b).items())[:3],
                   only_oracle=list((b - a).items())[:3])
    return out


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    names = names or sorted(QUERIES)
    from wordloom.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=n, status="ERROR", error=str(e)[:800])
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
