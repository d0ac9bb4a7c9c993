"""Shared scratch tables: the way lineage is cut.

Everything is written under ``spark.checkpoint.dir`` (a folder that the driver and all executors share), by
Spark's own writers, so a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    own = getattr(spark, "_tarn_shared_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark._tarn_shared_dir = own
    return own


#: Batches that go to Python hold whole texts, so they are bounded by size too, not by rows alone.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limits of Arrow batches to ``BATCH``; a limit that was set already stays."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


class Scratch:
    """A folder of tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table, free of its lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)
