"""Rows of Spark and of DuckDB in one form."""

from __future__ import annotations

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def rows_of_sql(sql: str, where: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
