"""Rows of a query against rows of its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of_sql(con, sql: str):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    return _normal(names, r.fetchall())


def rows_of_frame(df):
    return _normal(df.columns, [tuple(r) for r in df.collect()])


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "quantize"):
        return float(x)
    return x


def differences(df, con, sql: str, most: int = 3):
    (a, x), (b, y) = rows_of_frame(df), rows_of_sql(con, sql)
    if a != b:
        return [f"columns {a} and {b}"]
    if len(x) != len(y):
        return [f"{len(x)} and {len(y)} rows"] + [f"only one side: {r}" for r in list({*map(repr, x)} ^ {*map(repr, y)})[:most]]
    return [f"{p} is not {q}" for p, q in zip(x, y) if p != q and [float(v) if isinstance(v, int) else v for v in p] != [float(v) if isinstance(v, int) else v for v in q]][:most]
