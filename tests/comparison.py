"""Rows of a query and of its DuckDB statement, made comparable."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.6g}")
    if isinstance(value, int):
        return float(f"{value:.6g}") if abs(value) < 1e15 else value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        files = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
