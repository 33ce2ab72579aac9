"""Session helpers: those of the engine, a folder that executors share, and names that don't clash."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import checkpoint, small_side

__all__ = ["checkpoint", "delete", "free_name", "shared_folder", "small_side"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint(spark.range(1))  # sets a folder where none is named
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of tables that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_name(base: str, columns: list[str]) -> str:
    """base, with underscores behind it if a column has that name."""
    while base in columns:
        base += "_"
    return base
