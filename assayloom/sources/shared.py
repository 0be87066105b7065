"""The folder that the driver and all executors share, for what jobs write in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, prefix: str = "assayloom") -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="assayloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` below the folder and read it back: cuts lineage and survives lost executors. ``partitions``: columns that become folders."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
