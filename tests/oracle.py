"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spark_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    scols = sorted(sdf.columns)
    if sql is None:
        return dict(name=name, ok=None, rows=len(spark_rows), spark_s=round(t1 - t0, 2))
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    if duck_types != spark_types:
        diff = {k: (spark_types.get(k), duck_types.get(k)) for k in set(duck_types) | set(spark_types)
                if spark_types.get(k) != duck_types.get(k)}
        return dict(name=name, ok=False, why=f"types differ (spark, duck): {diff}")
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drecs = [dict(zip(dcols, r)) for r in res.fetchall()]
    if sorted(dcols) != scols:
        return dict(name=name, ok=False, why=f"columns spark={scols} duck={sorted(dcols)}")
    a, b = rows_of(spark_rows, scols), rows_of(drecs, scols)
    if len(a) != len(b):
        return dict(name=name, ok=False, why=f"rows spark={len(a)} duck={len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return dict(name=name, ok=False, why=f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}")
    return dict(name=name, ok=True, rows=len(a), spark_s=round(t1 - t0, 2))


def main(argv):
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tidewell.session import local_session
    spark = local_session()
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, qs[name], oracle.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(exc).__name__}: {str(exc)[:400]}")
        fails += r.get("ok") is False
        print(r, flush=True)
    print(f"failures: {fails}")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
