"""Run registered queries on Spark and their SQL on DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from tallymark.plans import catalogue
from tallymark.plans.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if abs(v) < 1e-3 else f"{v:.6f}"
    if isinstance(v, Decimal):
        return f"d{v.normalize():f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def _kind(v) -> str:
    return type(v).__name__ if v is not None else "none"


def compare(spark, sf_dir: str, name: str, con=None) -> str:
    """Empty text when both agree, else a short description."""
    fn = catalogue.queries()[name]
    sql = catalogue.oracles().get(name)
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return "" if df.columns else "no columns"
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} oracle {sorted(names)}"
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in rows]
    at = [names.index(c) for c in order]
    want = [tuple(r[i] for i in at) for r in want_rows]
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} oracle {len(want)}"
    for i, c in enumerate(order):
        kinds = {_kind(r[i]) for r in got} - {"none"}, {_kind(r[i]) for r in want} - {"none"}
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            return f"types differ in {c}: spark {kinds[0]} oracle {kinds[1]}"
    a, b = Counter(map(_plain, got)), Counter(map(_plain, want))
    if a != b:
        return f"values differ: {order} only spark {list((a - b).items())[:3]} only oracle {list((b - a).items())[:3]}"
    return ""


if __name__ == "__main__":
    from tests.conftest import make_session

    sf = sys.argv[1]
    chosen = sys.argv[2:]
    spark = make_session()
    con = duck(sf)
    bad = 0
    for q in catalogue.queries():
        if chosen and not any(q.startswith(c) for c in chosen):
            continue
        t = time.time()
        try:
            problem = compare(spark, sf, q, con)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        note = "" if q in catalogue.oracles() else " (rows only)"
        print(f"{'BAD' if problem else 'ok '} {q}{note} {time.time() - t:.1f}s {problem}", flush=True)
    print("failures:", bad)
