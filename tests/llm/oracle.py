"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import glob

import duckdb


def rows_of_sql(sql: str, sf: str, **tables) -> list[tuple]:
    """Rows of the SQL over the tables of sf; `tables` (Arrow) stand in for those of their names."""
    with duckdb.connect() as con:
        for path in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
        for name, table in tables.items():
            con.execute(f"DROP VIEW IF EXISTS {name}")
            con.register(name, table)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def rows_of_frame(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
