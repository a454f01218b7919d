"""Spark result vs DuckDB oracle, the way the driver compares them:
row count, column names and types, and an order-insensitive multiset of
normalized rows.  Run directly: ``python tests/parity.py [sf_dir] [keys...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "date": "DATE", "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT",
                  "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT"}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def compare(spark, sf_dir: str, key: str, builder_q, sql: str, con) -> dict:
    t0 = time.time()
    sdf = builder_q(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = [str(d[1]) for d in res.description]
    d_rows = res.fetchall()
    out = {"key": key, "spark_rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t1 - t0, 2)}
    out["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    if not out["cols_ok"]:
        out["cols"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
    s_t = dict(zip(s_cols, (_SPARK_TO_DUCK.get(t, t) for t in s_types)))
    d_t = dict(zip(d_cols, d_types))
    bad = {c: (s_t[c], d_t[c]) for c in s_t if c in d_t and s_t[c] != d_t[c]
           and not (s_t[c].startswith("decimal") and d_t[c].startswith("DECIMAL"))}
    out["types_ok"] = not bad
    if bad:
        out["types"] = bad
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    out["values_ok"] = a == b
    if not out["values_ok"]:
        out["only_spark"] = list((a - b).elements())[:3]
        out["only_oracle"] = list((b - a).elements())[:3]
    out["ok"] = out["cols_ok"] and out["values_ok"] and len(s_rows) == len(d_rows)
    return out


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import local_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session()
    qs, orc = queries(), oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for k in (keys or list(qs)):
        if k not in orc:
            print(f"-- {k}: no oracle")
            continue
        try:
            r = compare(spark, sf_dir, k, qs[k], orc[k], con)
        except Exception as exc:  # report and continue
            r = {"key": k, "ok": False, "error": repr(exc)[:600]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + repr(r), flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main(sys.argv)
