"""Compare each registered Spark query with its DuckDB oracle.

Same checks as the correctness gate: row count, column names, and an
order-insensitive hash of the values.  Run as a script for a report:

    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "NULL"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None) -> dict[str, dict]:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        rec = {"spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
        if name in sqls:
            rel = con.sql(sqls[name])
            o_cols = rel.columns
            o_rows = rel.fetchall()
            rec.update(
                oracle_rows=len(o_rows),
                columns_match=sorted(s_cols) == sorted(o_cols),
                hash_match=digest(s_cols, s_rows) == digest(o_cols, o_rows),
            )
            if not rec["columns_match"]:
                rec["spark_columns"] = s_cols
                rec["oracle_columns"] = o_cols
        report[name] = rec
    return report


if __name__ == "__main__":
    from ledgerlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    for k, v in compare(spark, sf, sys.argv[2:] or None).items():
        ok = v.get("hash_match") and v.get("columns_match") and v["spark_rows"] == v.get("oracle_rows")
        print(f"{'OK ' if ok else 'BAD'} {k:34s} {v}")
