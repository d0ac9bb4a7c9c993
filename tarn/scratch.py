"""Folders for tables that a call writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def named_root(spark: SparkSession) -> str | None:
    """The cluster's ``spark.checkpoint.dir``, which all nodes share; a temporary folder on one machine only, else none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = getattr(spark, "_tarn_scratch_root", None) or "file://" + tempfile.mkdtemp(prefix="tarn-store-")
        spark._tarn_scratch_root = named
    return named or None


def scratch_root(spark: SparkSession, name: str = "store") -> str:
    """A new folder that all nodes share, deleted when the session ends."""
    named = named_root(spark)
    if named is None:
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    root = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root
