"""A query's rows against its SQL's, as the driver compares them: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_value(r[i]) for i in order]) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return ""
    extra, missing = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
    return f"columns {got[0]} {want[0]}; rows {len(got[1])} {len(want[1])}; only Spark {extra}; only SQL {missing}"
