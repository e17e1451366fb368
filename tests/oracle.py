"""Compare a query with its SQL: same rows, whatever their order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: (v is not None, round(v, 9) if isinstance(v, float) else v)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, db, run, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = run(spark, sf_dir)
    result = db.execute(sql)
    columns, want = [c[0] for c in result.description], result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, want)
    if a != b:
        return f"{len(a)} rows against {len(b)}; first {[(x, y) for x, y in zip(a, b) if x != y][:1]}"
    return ""
