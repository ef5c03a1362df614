"""Comparison of a query with its DuckDB twin."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


KINDS = {"int": "BIGINT", "bigint": "BIGINT", "smallint": "BIGINT", "tinyint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN"}
DUCK_KINDS = {"INTEGER": "BIGINT", "SMALLINT": "BIGINT", "TINYINT": "BIGINT", "FLOAT": "DOUBLE"}


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "tuple", str(x)) for x in r])


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs between a query's rows and its twin's; empty if nothing does."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = {n: DUCK_KINDS.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    for n, t in df.dtypes:
        if KINDS.get(t, kinds[n]) != kinds[n]:
            return f"type of {n}: {t} and {kinds[n]}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(df.columns)}: {x} and {y}"
    return ""
