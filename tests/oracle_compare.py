"""Compare a registered Spark query with its DuckDB oracle (like the driver's gate).

Usage: python tests/oracle_compare.py [sf_dir] [name-prefix ...]
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

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


_SPARK2DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
    "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def spark_type(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type(t[6:-1]) + "[]"
    return _SPARK2DUCK.get(t, t)


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from herbaria.plans.catalog import ORACLE, QUERIES
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    s_types = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields}
    s_rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    t1 = time.time()
    if name not in ORACLE:
        return False, f"no oracle; rows={len(s_rows)} spark={t1 - t0:.1f}s"
    con = con or duck(sf_dir)
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if sorted(d_cols) != cols:
        return False, f"columns differ: spark={cols} duck={sorted(d_cols)}"
    bad_types = {c: (s_types[c], d_types[c]) for c in cols if s_types[c] != d_types[c]}
    data = rel.fetchall()
    idx = [d_cols.index(c) for c in cols]
    d_rows = sorted((tuple(norm(r[i]) for i in idx) for r in data), key=repr)
    msg = f"rows spark={len(s_rows)} duck={len(d_rows)} spark={t1 - t0:.1f}s"
    if bad_types:
        return False, f"types differ {bad_types}; " + msg
    if s_rows != d_rows:
        s_set, d_set = set(s_rows), set(d_rows)
        only_s = list(s_set - d_set)[:3]
        only_d = list(d_set - s_set)[:3]
        return False, f"values differ; {msg}; cols={cols}; only spark {only_s}; only duck {only_d}"
    return True, msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in argv[1:] if not a.startswith("/")]
    from herbaria.session import get_session
    from herbaria.plans.catalog import QUERIES
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    names = [n for n in QUERIES if not prefixes or any(n.startswith(p) for p in prefixes)]
    fails = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        fails += not ok
        print(("PASS " if ok else "FAIL ") + n + " " + msg, flush=True)
    print(f"{len(names) - fails}/{len(names)} passed")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
