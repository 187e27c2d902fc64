"""Run registered queries in Spark and their SQL twins in DuckDB, compare like the driver does:
row count, column names, and an order-insensitive hash of the values.

Usage: python tests/oracle_compare.py [sf_dir] [query-name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = bool(os.environ.get("STRICT"))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6)) if not STRICT else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def table_hash(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(row[i]) for i in order) for row in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}


def type_diff(df, con, sql):
    """Columns whose Spark type differs from the DuckDB type of the SQL twin."""
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (SPARK_TO_DUCK.get(t, t), duck.get(c)) for c, t in df.dtypes
            if SPARK_TO_DUCK.get(t, t) != duck.get(c)}


def duckdb_con(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    import __spark_entry__ as entry
    from parcelspark.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb_con(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        dt = time.time() - t0
        if name not in oracle:
            print(f"{name}: rows={len(rows)} (no oracle) {dt:.1f}s")
            continue
        res = con.execute(oracle[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        h1, l1 = table_hash(cols, rows)
        h2, l2 = table_hash(ocols, orows)
        types = type_diff(df, con, oracle[name])
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2 and not types
        bad += not ok
        print(f"{name}: {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} {dt:.1f}s")
        if not ok:
            if types:
                print("  types (spark, duck):", types)
            if sorted(cols) != sorted(ocols):
                print("  cols spark:", sorted(cols), "\n  cols duck: ", sorted(ocols))
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:4]:
                print("  spark only:", x[:300])
            for x in sorted(s2 - s1)[:4]:
                print("  duck  only:", x[:300])
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
