"""Run a registered Spark query and its DuckDB oracle and compare the results.

Usable from pytest (``tests/test_oracle.py``) and as a script:
    python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, "" if x is None else str(type(x).__name__), "" if x is None else str(x)) for x in row)


def spark_rows(df):
    cols = df.columns
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
    return cols, rows


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    scols, srows = spark_rows(df)
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": True, "rows": len(srows), "note": "rows-only", "spark_s": round(t1 - t0, 2)}
    dcols, drows = duck_rows(con, sql)
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, note=f"columns differ: {scols} vs {dcols}")
        return res
    order = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in order) for r in drows]
    srows.sort(key=_key)
    drows.sort(key=_key)
    if len(srows) != len(drows):
        res.update(ok=False, note="row count differs")
        return res
    for a, b in zip(srows, drows):
        if a != b:
            res.update(ok=False, note=f"first diff: spark={str(a)[:300]} oracle={str(b)[:300]}")
            return res
    res.update(ok=True)
    return res


def main(argv):
    from commitlens.session import get_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(entry.queries())
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "note": f"error: {type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
