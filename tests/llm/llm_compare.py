"""Rows of a registered query against its SQL."""

import duckdb

from geoloom.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


def differences(spark, name: str, folder: str) -> list:
    run, sql = registry.load()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, rel = run(spark, folder), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(dict(zip(rel.columns, r))[c] for c in names) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    return [(a, b) for a, b in zip(ours, theirs) if a != b][:5]
