"""Spark rows against DuckDB rows, columns by name and rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


def check(con, sql, frame):
    found = con.execute(sql)
    want = _canonical([d[0] for d in found.description], found.fetchall())
    assert _canonical(frame.columns, frame.collect()) == want
