"""A query's rows and its SQL's rows, made comparable."""

import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def both(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    return ordered(df.select(*columns).collect()), ordered(found.select(*[f'"{c}"' for c in columns]).fetchall())
