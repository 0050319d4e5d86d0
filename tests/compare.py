"""Compare a Spark result with a DuckDB result, ignoring row order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v) if v is not None else None


def differences(spark_df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(rel.columns):
        return f"columns {sorted(set(names) ^ set(rel.columns))}"
    pos = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[p]) for p in pos) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    if want == got:
        return None
    missing, extra = list((want - got).items())[:2], list((got - want).items())[:2]
    return f"rows {sum(got.values())} vs {sum(want.values())}; columns {names}\n missing {missing}\n extra {extra}"
