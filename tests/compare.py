"""Comparison of a registered query with its SQL."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a statement; empty when nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = _rows(names, result.fetchall())
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} <> {theirs[0]}"]
    for field in df.schema.fields:
        expected = KINDS.get(field.dataType.simpleString())
        if expected != kinds[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} <> {kinds[field.name]}")
    if len(mine[1]) != len(theirs[1]):
        found.append(f"rows {len(mine[1])} <> {len(theirs[1])}")
    left, right = set(map(repr, mine[1])), set(map(repr, theirs[1]))
    found += [f"only here {r[:600]}" for r in sorted(left - right)[:2]]
    found += [f"only there {r[:600]}" for r in sorted(right - left)[:2]]
    return found
