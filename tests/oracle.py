"""Compare a query with its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in os.listdir(sf_dir):
        path = os.path.join(sf_dir, t)
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
