"""Run a query in Spark and its SQL in DuckDB and hold the results against each other."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean",
    "DOUBLE": "double", "BLOB": "binary", "UBIGINT": "ubigint", "HUGEINT": "hugeint",
}


def expected(sf_dir: str, sql: str) -> tuple[dict[str, str], Counter]:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: _TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    return types, _rows(names, cursor.fetchall())


def actual(df) -> tuple[dict[str, str], Counter]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return types, _rows(df.columns, df.collect())


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def mismatch(df, sf_dir: str, sql: str) -> str | None:
    """None if schema and rows agree, else what differs."""
    want_types, want = expected(sf_dir, sql)
    got_types, got = actual(df)
    if want_types != got_types:
        return f"schema: expected {want_types}, got {got_types}"
    if want != got:
        missing, extra = list((want - got).items()), list((got - want).items())
        return f"{len(missing)} missing, {len(extra)} extra; e.g. {missing[:2]} / {extra[:2]}"
    return None
