"""Runs registered queries against their SQL in DuckDB, as the driver does: sorted columns, order-free rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        value = round(value, 6)
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    return value if isinstance(value, (str, int, bool)) else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    found = run(spark, sf_dir)
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    if sorted(names) != sorted(found.columns):
        return [f"columns {sorted(found.columns)}, SQL has {sorted(names)}"]
    a, b = rows_of(found.columns, found.collect()), rows_of(names, wanted.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows, SQL has {len(b)}; first {a[:1]} and {b[:1]}"]
    return [f"{x} but SQL has {y}" for x, y in zip(a, b, strict=True) if x != y][:3]
