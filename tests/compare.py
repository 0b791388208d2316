"""Row-by-row comparison of a named query with its SQL counterpart in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
              "boolean": "BOOLEAN"}


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        file = Path(path) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{file}')")
    return con


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns, types and the bag of rows agree, else what differs."""
    relation = con.sql(sql)
    ours = {n: DUCK_TYPES.get(t, t) for n, t in df.dtypes}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if ours != theirs:
        return f"schema: {ours} against {theirs}"
    names = sorted(ours)
    left = Counter(tuple(r[n] for n in names) for r in df.collect())
    order = [relation.columns.index(n) for n in names]
    right = Counter(tuple(r[i] for i in order) for r in relation.fetchall())
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (f"{sum(only_left.values())} of {sum(left.values())} rows only in Spark, "
            f"{sum(only_right.values())} of {sum(right.values())} only in DuckDB; "
            f"e.g. {sorted(only_left, key=str)[:2]} against {sorted(only_right, key=str)[:2]}")
