"""Checksums of objects and of their byte ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import ANNOTATIONS, METHODS, Method
from ..plans import is_small, offsets
from ..sources import read_range, slice_bytes


def blocks(content: Column, size: Column, block_size: Column, algorithm: str) -> Column:
    """Array of (offset, length, checksum) of a binary column's blocks, at least one; the bytes aren't carried into a row per block."""
    length = lambda o: F.least(block_size, size - o).cast("bigint")
    one = lambda data, o: F.struct(o.alias("offset"), length(o).alias("length"), fn.digest(slice_bytes(data, o, length(o)), algorithm).alias("checksum"))
    return fn.once(content, lambda data: F.transform(offsets(F.greatest(block_size, F.lit(1)), F.greatest(size, F.lit(1))), lambda o: one(data, o)))


def block_checksums(objects: DataFrame, m: Method) -> DataFrame:
    """Annotations of objects with their bytes (bucket, key, size, content): whole if small or unblocked, else one per block. Stays in the JVM."""
    block = F.when(is_small(F.col("size"), m), F.col("size")).otherwise(F.lit(m.block_size)) if m.needs_offsets else F.col("size")
    rows = objects.select(fn.url(F.col("bucket"), F.col("key")).alias("url"), F.explode(blocks(F.col("content"), F.col("size"), block, m.algorithm)).alias("b"))
    return rows.select("url", "b.offset", "b.length", F.lit(m.id).alias("method"), "b.checksum")


def range_checksum(content: Column, offset: Column, length: Column, algorithm: str = "md5") -> Column:
    """Digest of bytes [offset, offset + length) of a binary column; to its end if length is null or 0."""
    return fn.digest(slice_bytes(content, offset, length), algorithm)


def file_checksum(path: str, offset: int = 0, length: int | None = None, algorithm: str = "md5") -> str:
    """Digest of a file's byte range, read in small chunks."""
    h = hashlib.new(algorithm)
    for data in read_range(path, offset, length):
        h.update(data)
    return h.hexdigest()


def checksum_tasks(tasks: DataFrame, root: str, *more: Method) -> DataFrame:
    """Annotations of task rows (url, size, method, block_size, offset) whose objects lie under root, by bucket and key.

    Each row's method names the algorithm: one of the registered methods or of
    ``more``; another is an error. A block may exceed what a binary column holds,
    so ranges are read by seek in Python, in chunks. Rows are spread by (url,
    offset); the task number, which puts all small objects together, is only a label.
    """
    algorithms = {m.id: m.algorithm for m in (*METHODS.values(), *more)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for url, method, block, offset in zip(*(b.column(c).to_pylist() for c in ("url", "method", "block_size", "offset"))):
                if method not in algorithms:
                    raise ValueError(f"unknown method {method!r} of {url}")
                sums.append(file_checksum(f"{root.rstrip('/')}/{url.replace('s3://', '')}", offset, block, algorithms[method]))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("url", "offset", "length", "method")] + [pa.array(sums, pa.string())], ["url", "offset", "length", "method", "checksum"])

    length = F.when(F.col("block_size") == 0, F.col("size")).otherwise(F.least(F.col("block_size"), F.col("size") - F.col("offset"))).cast("bigint")
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tasks.select("url", "offset", length.alias("length"), "method", "block_size").repartition(n, "url", "offset")
    return spread.mapInArrow(run, ANNOTATIONS)
