"""The structure audit over a folder that keeps receiving pages.

Each micro-batch is audited by the batch operator and written to a folder of its own number,
so a batch that runs again after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from citescope.operators import audit

PAGES = "page_id bigint, url string, raw_html string, rendered_html string"


def landing_pages(
    spark: SparkSession, folder: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of pages as they land."""
    return (
        spark.readStream.schema(PAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def audit_stream(
    pages: DataFrame,
    target: str,
    checkpoint: str,
    site_files: Callable[[SparkSession], DataFrame] | None = None,
) -> DataStreamWriter:
    """Writer of the audit of new pages into ``target``, with a column ``batch_id``.

    ``site_files`` reads the files that sites have landed; it is called for each batch, so a
    file counts from the next batch on.  Without it only embedded llm.txt content counts.
    ``checkpoint`` belongs in storage that all executors share.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = None if site_files is None else site_files(batch.sparkSession)
        audit.structure_analysis(batch, files).write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
