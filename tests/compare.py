"""Rows of Spark and of DuckDB, made comparable: any order of rows and columns, floats to nine places."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in data)


def assert_same(df, con, sql):
    q = con.sql(sql)
    assert sorted(df.columns) == sorted(q.columns)
    a, b = rows([tuple(r) for r in df.collect()], df.columns), rows(q.fetchall(), q.columns)
    assert len(a) == len(b)
    assert a == b
