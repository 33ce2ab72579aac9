"""Writers: task files, annotation text, N-Triples, entity documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import SMALL_BYTES
from ..session import checkpoint


def write_task_files(tasks: DataFrame, folder: str) -> None:
    """A file task_N per task with its lines; the last task, that of the small objects, has one even if it is empty."""
    uri = folder.rstrip("/") if "://" in folder else os.path.abspath(folder)

    def write(number: int, lines: Iterator[str]) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/task_{number}") as out:
            for x in lines:
                out.write(x.encode() + b"\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, v) for b in batches for n, v in zip(b.column("task_num").to_pylist(), b.column("value").to_pylist()))
        for number, own in groupby(rows, key=lambda r: r[0]):
            write(number, (v for _, v in own))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["task_num"])

    line = fn.task_line(F.col("url"), F.col("size"), F.col("method"), F.col("block_size"), F.col("offset")).alias("value")
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tasks.select("task_num", "url", "offset", line).repartition(n, "task_num").sortWithinPartitions("task_num", "url", "offset")
    rows.select("task_num", "value").mapInArrow(run, "task_num long").count()
    small = (F.col("size") < SMALL_BYTES) | (F.col("size") < F.col("block_size") / 2)
    last = tasks.agg(F.max(F.struct("task_num", small.alias("small"))).alias("x")).select("x.*").first()
    if not last.small:
        write((last.task_num or 0) + 1, iter(()))


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """Legacy text of annotations, in order of url and offset; they are made once, into the checkpoint folder, and not again for the sort."""
    return checkpoint(annotations).orderBy("url", "offset").select(fn.annotation_line(F.col("url"), F.col("checksum")).alias("value"))


def write_annotations(annotations: DataFrame, path: str, one_file: bool = False) -> None:
    """Text in order, as a folder of parts."""
    _write_text(annotation_lines(annotations), path, one_file)


def _write_text(lines: DataFrame, path: str, one_file: bool) -> None:
    """A folder of parts in order; as one file, they are joined byte by byte where they lie, so that no task holds them all."""
    if not one_file:
        lines.write.text(path)
        return
    from pyarrow import fs

    lines.write.text(f"{path}.parts")
    store, at = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    parts = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{at}.parts")) if i.base_name.startswith("part-"))
    with store.open_output_stream(at) as out:
        for p in parts:
            with store.open_input_stream(p) as f:
                while data := f.read(8 << 20):
                    out.write(data)
    store.delete_dir(f"{at}.parts")


def combine_lines(spark: SparkSession, inputs: list[str], path: str, one_file: bool = True) -> None:
    """Legacy text files into one, by url. A line holds no offset, so a url's lines stay in the order of the inputs and of their lines."""
    parts = []
    for i, x in enumerate(inputs):
        t = spark.read.text(x)
        place = F.struct(F.lit(i).alias("i"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
        parts.append(t.select("value", F.regexp_extract("value", r"^<(.*)>  [0-9a-f]+$", 1).alias("url"), place.alias("place")).where(F.col("value") != ""))
    _write_text(reduce(DataFrame.unionAll, parts).orderBy("url", "place").select("value"), path, one_file)


def _escaped(c: Column) -> Column:
    for a, b in ((r"\\", r"\\\\"), ('"', r"\\\""), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        c = F.regexp_replace(c, a, b)
    return c


def ntriples(quads: DataFrame) -> DataFrame:
    """Quads as N-Triples lines; graphs aren't part of the format."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    kind = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(F.lit(""))
    value = F.when(F.col("object_kind") == "iri", node(F.col("object"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("object")), F.lit('"'), kind))
    return quads.select(F.concat(node(F.col("subject")), F.lit(" <"), "predicate", F.lit("> "), value, F.lit(" .")).alias("value")).distinct()


def write_turtle(quads: DataFrame, path: str) -> None:
    """Quads as Turtle: a statement per line with whole names, so that every part is a document of its own."""
    ntriples(quads).write.text(path)


def write_ntriples(quads: DataFrame, path: str) -> None:
    ntriples(quads).write.text(path)


def to_json(entities: DataFrame, name: str) -> DataFrame:
    """An entity per line, with its class as "@type"; empty lists and nulls are left out."""
    cols = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in entities.dtypes]
    return entities.select(F.to_json(F.struct(*cols, F.lit(name).alias("@type"))).alias("value"))


def to_yaml(entities: DataFrame, name: str) -> DataFrame:
    """An entity per row as a YAML document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            docs = [yaml.dump({k: v for k, v in row.items() if v not in (None, [])}, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], ["value"])

    return entities.mapInArrow(run, "value string")
