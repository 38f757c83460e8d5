"""Side-by-side comparison of a query with its SQL, value by value."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_types(df):
    return dict(sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields))


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def differences(df, con, sql, limit=5):
    """Empty if the results are equal; otherwise a description of what differs."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if got[0] != expected[0]:
        return [f"columns {got[0]} against {expected[0]}"]
    for name, kind in spark_types(df).items():
        want = DUCK_TYPES.get(kind, kind.upper().replace(" ", ""))
        if want != types[name].replace(" ", ""):
            problems.append(f"type of {name}: {kind} against {types[name]}")
    if len(got[1]) != len(expected[1]):
        problems.append(f"{len(got[1])} rows against {len(expected[1])}")
    if got[1] != expected[1]:
        ours, theirs = set(got[1]), set(expected[1])
        problems.append(f"only ours: {sorted(ours - theirs, key=str)[:limit]}")
        problems.append(f"only oracle: {sorted(theirs - ours, key=str)[:limit]}")
    return problems
