"""Run a query and its SQL oracle on the same tables and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = sorted(tuple(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], cells


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql: str):
    found = con.sql(sql)
    return _table(found.columns, found.fetchall())


def difference(got, want) -> str:
    """Empty when equal, else a short account of what differs."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(got[1]), set(want[1])
    return (
        f"rows {len(got[1])}/{len(want[1])}; only here {sorted(a - b)[:2]}; "
        f"only in SQL {sorted(b - a)[:2]}; differing {len(a - b)}/{len(b - a)}"
    )
