"""Rows of a query and of its SQL, in one form."""

import decimal
from pathlib import Path

import duckdb
from pyspark.sql import functions as F


def form(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{form(v[k])}" for k in v) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(form, v)) + "]"
    return str(v)


def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(form(r[i]) for i in order) for r in data)


def same(spark, connection, query, sql, sf_dir):
    df = query(spark, sf_dir)
    # Entries of maps keep their order only as lists.
    maps = [c for c, kind in df.dtypes if kind.startswith("map")]
    df = df.withColumns({c: F.map_entries(c) for c in maps})
    listed = ", ".join(f"map_entries({c}) AS {c}" for c in maps)
    cursor = connection.execute(f"SELECT * REPLACE ({listed}) FROM ({sql})" if maps else sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())
