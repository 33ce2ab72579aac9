"""The same planning and checksums over files that arrive: a listing stream with annotations per micro-batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..model import Method
from ..operators.checksum import block_checksums


def arriving_objects(spark: SparkSession, bucket: str, folder: str) -> DataFrame:
    """Files put under folder or its sub-folders, with their bytes; keys are paths below folder. The source skips empty files."""
    from pyarrow import fs

    _, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    base = base.strip("/") + "/"
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    key = F.substring("path", F.instr("path", base) + len(base), F.length("path"))
    return files.select(F.lit(bucket).alias("bucket"), key.alias("key"), F.col("length").alias("size"), "content")


def annotate_stream(objects: DataFrame, m: Method, out: str, checkpoint: str) -> StreamingQuery:
    """Append each object's annotations to Parquet, exactly once; what is there is taken in one go."""
    return block_checksums(objects, m).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
