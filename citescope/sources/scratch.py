"""Tables written between the steps of an operator, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, as in tests, a local session gets a folder of its machine; on a cluster
    no such folder is seen by all executors, so it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="citescope-shared-")
    return _OWN[key]


class Scratch:
    """Written tables of one run of an operator.

    A written table cuts the lineage: if an executor is lost, later steps read the table
    again.  All go when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def save_counting(self, df: DataFrame, name: str, condition: str) -> tuple[DataFrame, int]:
        """The written table, and how many of its rows meet a condition, counted while writing."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
        # of a plan that turns out to be empty nothing is observed
        return saved, int(seen.get.get("n") or 0)
