"""Comparing a query's rows with those of its SQL in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return "∅"
    if isinstance(x, bool):
        return f"b{x}"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return f"[{','.join(map(cell, x))}]"
    return f"{type(x).__name__[0]}{x}"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in found)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(df, sql, con):
    """None, or what differs."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        extra, missing = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return f"{len(mine[1])} and {len(theirs[1])} rows; extra {sorted(extra)[:2]}, missing {sorted(missing)[:2]}"
    return None
