"""Compare a query with its SQL twin, as multisets of rounded rows."""

from __future__ import annotations

import math

import duckdb

from lakeloom.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def rows(names: list[str], data) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_value(r[i]) for i in order)) for r in data)


def check(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
