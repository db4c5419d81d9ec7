"""Compare a query with its SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differ(spark_df, con, sql: str) -> str:
    """What differs, or nothing."""
    got_rows, rel = spark_df.collect(), con.sql(sql)
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(rel.columns)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(rel.columns, rel.fetchall())
    return "" if got == want else f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
