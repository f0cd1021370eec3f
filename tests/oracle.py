"""Compare each query with its SQL text, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


KIND = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def compare(con, sql: str, df) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    want, want_names = rows_of(rel.columns, rel.fetchall())
    got, got_names = rows_of(df.columns, df.collect())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    kinds = {f.name: KIND.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema.fields}
    sql_kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {n: (kinds[n], sql_kinds[n]) for n in kinds if kinds[n] != sql_kinds[n]}
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; types {odd}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}; types {odd}"
    return f"TYPES {odd}" if odd else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = __import__("__spark_entry__")
    from patronage.session import build_session

    folder = sys.argv[1]
    picks = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                verdict = compare(con, sqls[name], df) or "ok"
            else:
                verdict = f"rows {len(df.collect())}"
        except Exception as e:  # keep going: the report lists every query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {verdict}", flush=True)
