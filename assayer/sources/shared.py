"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only a local master, as in tests, may do without:
    then driver and executors are one process and a fresh temporary folder serves.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="assayer-")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes what is no longer read.

    Results may read the others until the application ends, and they are removed then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/assayer-{uuid.uuid4().hex}"
        self.count = 0

    def place(self) -> str:
        """A new path, which is removed with the others."""
        self.count += 1
        if self.count == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(root)
            files.deleteOnExit(root)
        return f"{self.root}/{self.count}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.place()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
