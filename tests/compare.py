"""Run a registered query and its SQL side by side and compare every value."""

from __future__ import annotations

import math

import duckdb

from geoloom.catalog import load, run
from geoloom.fixtures import TABLES


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_clean(v) for v in value)
    return value


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def compare(spark, con, name: str, folder: str) -> list[str]:
    """Differences found; empty when the two results are equal."""
    df = run(name, spark, folder)
    got = df.collect()
    sql = load()[name].sql
    if sql is None:
        return [] if df.columns else ["no columns"]
    rel = con.sql(sql)
    problems = []
    ours, theirs = dict(df.dtypes), dict(zip(rel.columns, (str(t) for t in rel.types)))
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    for c, t in ours.items():
        if _TYPES.get(t, t) != theirs[c]:
            problems.append(f"type of {c}: {t} against {theirs[c]}")
    names = sorted(ours)
    order = [rel.columns.index(c) for c in names]
    left = sorted((tuple(_clean(r[c]) for c in names) for r in got), key=repr)
    right = sorted((tuple(_clean(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows against {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        only_a, only_b = sorted(a - b, key=repr), sorted(b - a, key=repr)
        problems.append(f"{names}: only ours {len(only_a)} {only_a[:2]}, only theirs {len(only_b)} {only_b[:2]}")
    return problems
