"""Compares a registered query with its DuckDB equivalent on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if hasattr(v, "isoformat") or type(v).__name__ == "Decimal" else v


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, db, fn, sql: str, sf_dir: str) -> str:
    """Empty if both agree; else what differs."""
    df = fn(spark, sf_dir)
    mine = _table(df.columns, df.collect())
    cur = db.execute(sql)
    theirs = _table([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows, such as {bad[:2]}" if bad else ""
