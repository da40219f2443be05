"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a folder of this machine. A cluster must name one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, shared_folder.own, ignore_errors=True)
    return f"file://{shared_folder.own}"


class Scratch:
    """Writes tables to a folder of its own and reads them again: cuts lineage, and lost executors lose nothing of them. The folder goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def __call__(self, df: DataFrame, *by: str) -> DataFrame:
        """The table written, in a folder for each value of the columns by, and read again."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, k: int) -> None:
        """Deletes the k-th table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> Scratch:
    return Scratch(spark)
