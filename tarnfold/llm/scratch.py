"""Written tables that cut lineage, kept in the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only where none is set (tests) a temporary one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """A run's own subfolder of the shared folder: ``table`` writes a frame there and reads it back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        self._tidy()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no frame in use reads any more, and lets Spark remove shuffle files left behind."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._tidy()

    def _tidy(self) -> None:
        """Spark removes the shuffle files of frames that neither Python nor Java refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()
