"""Row-for-row comparison of a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value: object) -> str:
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "∅"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, con, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        extra = next((a for a in actual if a not in set(expected)), None)
        return f"{len(actual)} rows vs {len(expected)}; only in Spark: {str(extra)[:600]}"
    for a, b in zip(actual, expected):
        if a != b:
            return f"columns {sorted(names)}\n  spark {str(a)[:900]}\n  sql   {str(b)[:900]}"
    return None
