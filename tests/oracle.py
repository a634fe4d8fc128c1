"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return v.normalize() if v else decimal.Decimal(0)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
