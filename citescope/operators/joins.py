"""Joins of very many rows with a table that has one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(rows: DataFrame, table: DataFrame, key: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """Left join by ``key``, of which one value may have a large part of all rows.

    Rows of a key go to ``salts`` places, by the hash of ``spread_by``, and the key's one row is
    repeated for each.  Adaptive execution would split such a key by itself only where
    both sides come straight from a shuffle, which an aggregated table does not; it still
    does so here, or broadcasts a table that turns out to be small.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
