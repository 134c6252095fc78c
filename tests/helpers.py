"""Compare a query with its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return bytes(value) if isinstance(value, bytearray) else value


def views(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in row) for row in df.select(columns).collect()), key=repr)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert got == wanted
