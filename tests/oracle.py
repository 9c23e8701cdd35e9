"""Compares a DataFrame with a DuckDB query over the same Parquet tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def same_rows(df, con, sql: str) -> None:
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(row[columns.index(n)]) for n in names) for row in cursor.fetchall()), key=repr)
    assert mine == theirs
