"""Compares a query's rows with those of its DuckDB SQL."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5f}"
    return f"{float(x):.5f}" if isinstance(x, int) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def differences(df, con, sql):
    """None if columns and rows agree, else what differs."""
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, wanted = rows_of(rel.columns, rel.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if got != want:
        a, b = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return f"{len(got)} and {len(want)} rows; only in Spark {a[:2]}; only in SQL {b[:2]}"
    return None
