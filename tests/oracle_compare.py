"""Spark query vs DuckDB oracle: row count, schema, order-insensitive values.

Usable from pytest (``tests/test_oracle.py``) and as a script:
``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def duck_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = sdf.collect()
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    out["columns_ok"] = sorted(s_cols) == sorted(d_cols)
    if not out["columns_ok"]:
        out["columns"] = (sorted(s_cols), sorted(d_cols))
        return out
    bad = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    out["types_ok"] = not bad
    if bad:
        out["types"] = bad
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sc = Counter(tuple(norm(r[i]) for i in si) for r in s_rows)
    dc = Counter(tuple(norm(r[i]) for i in di) for r in d_rows)
    out["values_ok"] = sc == dc
    if sc != dc:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        out["diff"] = {"cols": order, "spark_only": only_s, "oracle_only": only_d}
    out["ok"] = out["columns_ok"] and out.get("types_ok", False) and out["values_ok"] and len(s_rows) == len(d_rows)
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):  # a session as a caller would build it, none of our defaults
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.sql.session.timeZone", os.environ.get("SESSION_TZ", "America/Los_Angeles"))
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        from traitgrid.session import build_session
        spark = build_session("local[8]", 8)
    con = duck_conn(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for n in names or list(qs):
        if n not in sqls:
            df = qs[n](spark, sf_dir)
            print({"name": n, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:1500]}
        failed += 0 if r.get("ok") else 1
        print(r, flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
