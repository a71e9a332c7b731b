"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame

REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def with_repeated_keys(df: DataFrame) -> DataFrame:
    """The frame, in a session whose JSON objects may repeat a key; its last value counts.

    Spark refuses such objects by default, and JSON-LD with one would be lost.  The setting is
    of the session; operators that parse JSON call this, so nobody has to know of it."""
    spark = df.sparkSession
    if spark.conf.get(REPEATED_KEYS, "false") != "true":
        spark.conf.set(REPEATED_KEYS, "true")
    return df
