"""Run registered queries in Spark and their SQL oracles in DuckDB and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = canon(srows, scols), canon(drows, dcols)
    ok = ok_cols and a == b
    info = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2),
                duck_s=round(td, 2))
    if not ok_cols:
        info["cols"] = (sorted(scols), sorted(dcols))
    elif not ok:
        sa, sb = set(a), set(b)
        info["only_spark"] = list(sa - sb)[:3]
        info["only_oracle"] = list(sb - sa)[:3]
    return info


def main(argv):
    sys.path.insert(0, "/root/repo")
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from scopeforge.session import local_session
    spark = local_session("8")
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            info = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # report and continue
            info = dict(name=name, ok=False, error=str(e)[:1500])
        bad += info.get("ok") is False
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
