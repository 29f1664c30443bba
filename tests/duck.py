"""Holding a query's rows against those of its SQL in DuckDB, as sets of typed values."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection in which every table of the folder is a view."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    """A value that both engines give alike: numbers to nine digits, structs and maps as sorted pairs."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value) + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return sorted((str(k), plain(x)) for k, x in value.items())
    return str(value)


def compared(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list, list]:
    """Spark's rows and DuckDB's, sorted, with columns in the order of their names."""
    columns = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in (x.asDict(True) for x in df.collect()))
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return mine, sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
