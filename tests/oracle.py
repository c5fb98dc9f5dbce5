"""Run registered queries on Spark and their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, fn, sql, sf_dir, con) -> str:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    for c, t in df.dtypes:
        if KINDS.get(t, t).split("(")[0] != kinds[c].upper().split("(")[0]:
            return f"type of {c}: spark {t} duckdb {kinds[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(got, df.columns), rows_of(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)}/{len(a)} rows differ, e.g. {sorted(df.columns)} {bad[0][0]} vs {bad[0][1]}" if bad else f"ok {len(a)}"
