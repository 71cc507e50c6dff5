"""Runs a query in Spark and its SQL in DuckDB, and compares rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(dicts):
    return sorted("|".join(f"{k}={plain(d[k])}" for k in sorted(d)) for d in dicts)


def spark_rows(df):
    return rows(r.asDict(True) for r in df.collect())


def duck_rows(c, sql):
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return rows(dict(zip(names, r, strict=True)) for r in cur.fetchall())
