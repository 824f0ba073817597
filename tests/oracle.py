"""Runs a query and its SQL over the same tables and compares rows and columns."""

from __future__ import annotations

import decimal
import os

import duckdb


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def rows_of(spark_df):
    columns = sorted(spark_df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in spark_df.collect()), key=repr)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def types_of(sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
