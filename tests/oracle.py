"""Compares queries with their SQL in DuckDB: names, number of rows and sorted values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    def one(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.6g}"
        return "null" if v is None else str(v)

    at = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in at], sorted(tuple(one(r[i]) for i in at) for r in values)


def check(df, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    cur = con.execute(sql)
    expected = rows([c[0] for c in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return None
    if got[0] != expected[0]:
        return f"columns {got[0]} and {expected[0]}"
    a, b = set(got[1]), set(expected[1])
    return f"{len(got[1])} and {len(expected[1])} rows; only here {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"
