"""Tables written between the steps of an operator, in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.sources.scratch import shared_folder


class Scratch:
    """Written tables of one run of an operator.

    A written table cuts the lineage: if an executor is lost, later steps read the table
    again.  ``drop`` removes a table that no later step reads; what is left, a result that
    still has to be read, goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, where: str, act):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return act(path.getFileSystem(conf), path)

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.parquet(where, partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the number and the text of each row, as ``doc_id`` and ``text``.

    Other columns, whatever their names, stay behind."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def in_fold(column: Column | str, mod: int, remainder: int) -> Column:
    """Whether the crc32 of a number as text leaves the remainder."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % mod == remainder
