"""Run a query and its SQL side by side."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(spark_df, con, sql: str) -> list:
    """Rows that only one side has; columns are matched by name."""
    names = sorted(spark_df.columns)
    ours = sorted(repr(tuple(r[c] for c in names)) for r in spark_df.select(names).collect())
    theirs = con.execute(f"select {', '.join(names)} from ({sql})").fetchall()
    theirs = sorted(repr(tuple(r)) for r in theirs)
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [f"{len(ours)} rows, {len(theirs)} by SQL", sorted(a - b)[:3], sorted(b - a)[:3]]
