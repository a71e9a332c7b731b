"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(
    df: DataFrame,
    path: str,
    fmt: str = "json",
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
    max_records_per_file: int = 1_000_000,
    replace: bool = False,
) -> None:
    """Write a result as JSON lines (UTF-8) or parquet.

    The number of rows per file is bounded, so a partition value that holds most of the
    rows becomes many files and not one.  With ``replace`` the values of ``partition_by`` that
    the result has take the place of what was there, and other values stay, so writing
    twice is writing once; rows of a value are brought together before, and large values
    split again, so there are few files.
    """
    if replace:
        if not partition_by:
            raise ValueError("name the columns whose values are replaced")
        df, mode = df.hint("rebalance", *partition_by), "overwrite"
    if fmt == "json":
        # VARIANT columns are written as the JSON they hold
        df = df.selectExpr(
            *[
                f"to_json(`{f.name}`) AS `{f.name}`"
                if f.dataType.simpleString() == "variant"
                else f"`{f.name}`"
                for f in df.schema.fields
            ]
        )
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    if replace:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def json_lines(df: DataFrame) -> DataFrame:
    """The rows as the JSON text ``write_results`` writes, for sinks that take text."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    )
