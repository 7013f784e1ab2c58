"""Run a query and its DuckDB twin on the same tables and compare rows, whatever their order."""

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6) + 0.0
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data) if all(None not in r for r in data) else sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf):
    """An empty string if equal, else what differs."""
    df = query(spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = connect(sf).sql(sql)
    theirs = rows(got.columns, got.fetchall())
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    if mine != theirs:
        extra, missing = [r for r in mine if r not in theirs][:3], [r for r in theirs if r not in mine][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {extra}, only there {missing}"
    return ""
