"""Compares a query with its SQL on DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.5f}"
    if hasattr(v, "as_tuple"):  # a decimal
        return f"{float(v):.5f}"
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([_plain(r[i]) for i in order] for r in rows)


def compare(spark, connection, name, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} and {names}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(differ)} of {len(got)} rows differ: {differ[:2]}" if differ else ""
