"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="binlattice-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Kept:
    """Tables written to the shared folder, so that they cut lineage and outlive executors; they go with the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.root = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        name = f"{self.root}/{self.count}"
        df.write.parquet(name)
        out = self.spark.read.schema(df.schema).parquet(name)
        out._kept_at = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            self._fs(df._kept_at).delete(self._path(df._kept_at), True)
