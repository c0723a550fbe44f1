"""Run a registered query in Spark and its SQL twin in DuckDB, and compare.

Comparison: same column names (sorted), same row count, same multiset of
rows after normalising values (floats to 6 decimals, timestamps and dates to
ISO text, nested lists element-wise).
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return round(v.total_seconds(), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = {"query": name, "spark_rows": len(s_rows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connection(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        res["status"] = "values differ"
        sa, sb = set(a), set(b)
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_duck"] = [r for r in b if r not in sa][:3]
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    from cohortspark.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = argv or list(queries())
    spark = local_session()
    con = duck_connection(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, queries()[n], sqls.get(n), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"query": n, "status": f"error: {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
