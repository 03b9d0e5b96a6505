"""Run a registered query on Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import time
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(x):
    if x is None:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return "T" if x else "F"
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        x = float(x)
        return None if math.isnan(x) else repr(x)
    if isinstance(x, int) or type(x).__name__.startswith(("int", "uint")):
        return repr(float(x))
    return str(x)


def rows(frame, columns):
    return Counter(tuple(norm(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def plain(frame):
    """pandas turns a nullable integer into a float; that is the same value here."""
    return frame.astype(object).where(frame.notna(), None)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    start = time.time()
    left = plain(fn(spark, sf_dir).toPandas())
    spent = time.time() - start
    result = {"name": name, "rows": len(left), "sec": round(spent, 2), "ok": True, "note": ""}
    if sql is None:
        result["note"] = "rows only"
        return result
    start = time.time()
    right = plain(con.sql(sql).df())
    result["sql_sec"] = round(time.time() - start, 2)
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        return result | {"ok": False, "note": f"columns {columns} vs {sorted(right.columns)}"}
    a, b = rows(left, columns), rows(right, columns)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return result | {"ok": False, "note": f"{columns}\n   spark {sum(a.values())} extra {sum((a - b).values())}: {only_a}\n   sql   {sum(b.values())} extra {sum((b - a).values())}: {only_b}"}
    return result
