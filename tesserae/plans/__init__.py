"""Planning: objects to numbered tasks of whole objects, blocks or small objects together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import Method
from ..session import checkpoint, small_side

SMALL_BYTES = 2**24
#: Offsets that a row stands for at most, when its range is spread over tasks.
SPREAD = 4096
SMALL, WHOLE, BLOCKS = "small", "whole", "blocks"


def offsets(block_size: Column, length: Column) -> Column:
    """0, b, 2b, ... below length as an array; empty if length isn't positive, an error if b is 0."""
    bad = F.raise_error(F.lit("block size must not be 0")).cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    step = F.when(block_size == 0, F.lit(1).cast("bigint")).otherwise(block_size.cast("bigint"))
    steps = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(length.cast("bigint") - 1, F.lit(0).cast("bigint")), step)).otherwise(none)
    return F.when(block_size == 0, bad).otherwise(steps)


def explode_offsets(rows: DataFrame, block_size: Column, length: Column, name: str) -> DataFrame:
    """A row for each of offsets(block_size, length), as a further column.

    Few input rows can have any number of offsets, and long ranges often follow
    each other in one file. So ranges are cut into runs of SPREAD offsets, and
    the runs, dealt out evenly, are what tasks explode.
    """
    b, n = block_size.cast("bigint"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.when(b < 2**40, b * SPREAD).otherwise(b)
    runs = rows.select("*", b.alias("_block"), length.cast("bigint").alias("_length"), span.alias("_span")).select("*", F.explode(offsets(F.col("_span"), F.col("_length"))).alias("_start"))
    run = offsets(F.col("_block"), F.least(F.col("_span"), F.col("_length") - F.col("_start")))
    return runs.repartition(n).select(*rows.columns, "_start", F.explode(run).alias("_in")).select(*rows.columns, (F.col("_start") + F.col("_in")).alias(name))


def is_small(size: Column, m: Method) -> Column:
    return (size < SMALL_BYTES) | (size < m.block_size / 2)


def route(size: Column, m: Method) -> Column:
    return F.when(is_small(size, m), SMALL).otherwise(F.lit(WHOLE if m.block_size == 0 else BLOCKS))


def n_blocks(size: Column, m: Method) -> Column:
    """Tasks of its own that an object gets."""
    own = F.lit(1)
    if m.block_size:
        own = (size - F.pmod(size, F.lit(m.block_size).cast("bigint"))) / m.block_size + F.when(size % m.block_size > 0, 1).otherwise(0)
    return F.when(is_small(size, m), F.lit(0)).otherwise(own).cast("bigint")


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums in the given order (nulls first), without one task for all rows; sums: new column to the one summed.

    Rows are range-partitioned and written once; sums per partition give each
    its start, and only within a partition is anything ordered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(n, *order)).withColumn("_part", F.spark_partition_id())
    each = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = each.withColumnRenamed("_part", "_p").select("_p", *(F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_base_{out}") for out in sums))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{out}") for out, c in sums.items()))
    rows = rows.join(small_side(checkpoint(base), 8 + 8 * len(sums)), F.col("_part") == F.col("_p"))
    return rows.select(*df.columns, *((F.col(f"_base_{out}") + F.col(f"_in_{out}")).cast("bigint").alias(out) for out in sums))


def plan_tasks(objects: DataFrame, m: Method) -> DataFrame:
    """Task rows of a listing (bucket, key, size): url, full size, method, block size and offset, numbered from 1 in key order; small objects share the last task.

    The listing is read once, into the checkpoint folder; only objects with
    tasks of their own are put in order.
    """
    o = checkpoint(objects.select("bucket", "key", "size").withColumn("_n", n_blocks(F.col("size"), m)))
    line = [fn.url(F.col("bucket"), F.col("key")).alias("url"), "size", F.lit(m.id).alias("method"), F.lit(m.block_size).cast("bigint").alias("block_size")]
    large = prefix_sums(o.where(F.col("_n") > 0), ["key", "bucket"], {"_before": "_n"})
    each = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    large = large.select("*", F.explode(each).alias("_i")).select((F.col("_before") + F.col("_i") + 1).alias("task_num"), *line, (F.col("_i") * m.block_size).cast("bigint").alias("offset"))
    last = o.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")).first()[0] + 1
    small = o.where(F.col("_n") == 0).select(F.lit(last).cast("bigint").alias("task_num"), *line, F.lit(0).cast("bigint").alias("offset"))
    return large.unionAll(small)


def with_length(tasks: DataFrame) -> DataFrame:
    """Tasks with the bytes each reads: its block, cut at the object's end, or the whole object."""
    small = (F.col("size") < SMALL_BYTES) | (F.col("size") < F.col("block_size") / 2)
    whole = (F.col("block_size") == 0) | small
    return tasks.withColumn("length", F.when(whole, F.col("size")).otherwise(F.least(F.col("block_size"), F.col("size") - F.col("offset"))).cast("bigint"))


def totals(objects: DataFrame) -> DataFrame:
    """(num_files, total_size); the sum is a decimal inside, so that it doesn't overflow before it is cast."""
    return objects.agg(F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum(F.col("size").cast("decimal(20,0)")), F.lit(0)).cast("bigint").alias("total_size"))


def split_prefix(prefix: str) -> tuple[str, str]:
    """Bucket and key prefix of "bucket/prefix"."""
    bucket, _, rest = prefix.partition("/")
    return bucket, rest


def split_bytes(text: Column, size: int) -> Column:
    """A text's UTF-8 bytes in pieces of size bytes."""
    cut = lambda data: F.transform(offsets(F.lit(size), F.octet_length(data)), lambda o: F.substring(data, (o + 1).cast("int"), F.lit(size)))
    return fn.once(F.encode(text, "UTF-8"), cut)
