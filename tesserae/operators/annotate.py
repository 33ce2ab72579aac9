"""Annotations: collected, combined, and turned into descriptor entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import DATA, PREFIXES, Method
from ..plans import plan_tasks
from ..session import checkpoint
from ..sources import list_files
from .checksum import checksum_tasks


def describe(spark: SparkSession, bucket: str, root: str, prefix: str, m: Method) -> DataFrame:
    """The whole job: list what lies under root/bucket, plan its tasks, checksum them, and give the annotations in order."""
    tasks = plan_tasks(list_files(spark, bucket, f"{root.rstrip('/')}/{bucket}", prefix), m)
    return combine(checksum_tasks(tasks, root, m))


def combine(*parts: DataFrame) -> DataFrame:
    """All annotations in order of url and offset; nothing is merged.

    They are written to the checkpoint folder first: a sort looks at its input
    twice, and objects should be read once.
    """
    return checkpoint(reduce(DataFrame.unionByName, parts)).orderBy("url", "offset")


def descriptors(annotations: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Descriptor entities of annotations; coverage needs the objects' sizes (url, size), else a whole object is taken for read."""
    a = annotations
    if sizes is not None:
        a = a.join(sizes.select("url", "size"), "url")
        cover = fn.coverage(F.col("length"), F.col("size"))
    else:
        cover = F.lit(1.0)
    return a.select(
        F.concat(F.col("url"), F.lit("#"), "method", F.lit("-"), F.col("offset").cast("string")).alias("id"),
        F.concat(F.lit(PREFIXES[DATA]), "method").alias("hasType"),
        F.col("checksum").alias("value"),
        "offset",
        "length",
        cover.cast("double").alias("coverage"),
        F.lit(None).cast("string").alias("label"),
        F.array().cast("array<string>").alias("hasDescriptor"),
    )


