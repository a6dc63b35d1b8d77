"""Spark's rows of a query beside those of its DuckDB SQL."""

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return v


def rows_of_sql(sql, folder):
    """(columns, rows) of ``sql`` over the Parquet tables of ``folder``."""
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=str)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str)
