"""A run's own folder in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Written tables that cut lineage; they outlive executors because every node sees the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
            if current.isDefined():
                folder = current.get()
            elif not (spark.sparkContext.master + "[").startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            else:  # one machine and nothing configured, as in tests
                folder = tempfile.mkdtemp(prefix="checkpoints-")
                spark.sparkContext.setCheckpointDir(folder)
        self.root = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
